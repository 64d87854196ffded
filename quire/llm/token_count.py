"""Token counts of whole texts with a public tokenizer, by overlap resynchronisation.

Short texts are encoded word by word, each distinct word of a task once. A huge text is cut into chunks of ``stride``
characters that overlap their successor by ``overlap`` characters; the chunks are
rows of their own and are encoded in different tasks. Two neighbouring chunks are
spliced at a boundary that both have in the overlap: a place behind white space
where a token ends in both and the next tokens are the same in both. Pre-tokens
hold no white space, and neither do the special tokens, so at such a place the
encodings of the two sides do not depend on each other. Where two chunks have no
such boundary the whole document is done again with a wider overlap, until one
chunk holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import packed, pieces
from quire.session import written

STRIDE = 32_768
OVERLAP = 512
WIDEN = 16
SAME_TOKENS = 4
BATCH_WORDS = 20_000
KNOWN = 400_000
LIMIT = 2048
#: Places behind other white space are not tried; these are enough in most texts.
STABLE = " \t\n\r"

CHUNK = "_row long, n_chunks long, chunk long, n long, left array<struct<at:long,n:long,next:string>>, right array<struct<at:long,n:long,next:string>>"


def _tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.no_truncation()
    own.no_padding()
    return own


def _counts(texts: pa.Array, own, known: dict[bytes, int]) -> list[int]:
    """Tokens of each text. White space belongs to no token, so a text has those of its words; words are kept in ``known``."""
    words = [(t.as_py() or b"").split() for t in texts.cast(pa.binary())]
    if len(known) > KNOWN:
        known.clear()
    new = list({w for own_words in words for w in own_words if w not in known})
    for i in range(0, len(new), BATCH_WORDS):
        part = new[i : i + BATCH_WORDS]
        made = own.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        known.update(zip(part, map(len, made), strict=True))
    return [sum(map(known.__getitem__, w)) for w in words]


def boundaries(text: str, offsets: list, ids: list[int], first: int, begin: int, end: int) -> list[dict]:
    """Stable places of a chunk that starts at ``first``, from ``begin`` to ``end``: tokens before, tokens after."""
    out = []
    for i in range(1, len(ids)):
        at = offsets[i][0]
        if begin <= at + first < end and offsets[i - 1][1] <= at and text[at - 1] in STABLE:
            after = ids[i : i + SAME_TOKENS]
            if len(after) == SAME_TOKENS:
                out.append({"at": at + first, "n": i, "next": ",".join(map(str, after))})
    return out


def token_counts(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    stride: int = STRIDE,
    overlap: int = OVERLAP,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``_doc, n_bytes, n_tokens``: every row with the UTF-8 bytes and the tokens of its text.

    Needs ``text``; the other columns stay in ``_doc``, all or those to ``keep``.
    Null counts as empty, an empty text has no tokens. ``tokenizer`` names a file
    of the public tokenizers. Repeated rows are counted each for itself; an empty
    table gives an empty table.
    """
    rows = packed(docs, keep=keep).schema
    texts = packed(docs, "text", keep=keep).withColumn("text", F.coalesce("text", F.lit("")))
    long = F.length("text") > stride
    schema = rows.add("n_bytes", "long").add("n_tokens", "long")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = _tokenizer(tokenizer), {}
        for batch in pieces(batches):
            made = pa.array(_counts(batch.column("text"), own, known), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("n_bytes"), made], ["_doc", "n_bytes", "n_tokens"])

    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    plain = texts.filter(~long).select("_doc", size, "text").mapInArrow(short, schema)
    huge = written(texts.filter(long).select("_doc", size, "text", F.monotonically_increasing_id().alias("_row")), "huge")
    done, left = None, huge.select("_row", "text")
    while True:
        counted = written(_spliced(left, tokenizer, stride, overlap), "spliced")
        sure = counted.filter("n_tokens is not null")
        done = sure if done is None else done.unionByName(sure)
        failed = counted.filter("n_tokens is null").select("_row")
        if failed.isEmpty():
            break
        overlap, stride = overlap * WIDEN, stride * 4
        left = huge.select("_row", "text").join(failed, "_row", "left_semi")
    return plain.unionByName(huge.join(done, "_row").select("_doc", "n_bytes", "n_tokens"))


def _spliced(texts: DataFrame, tokenizer: str, stride: int, overlap: int) -> DataFrame:
    """``_row, n_tokens`` of each text; null if two neighbouring chunks have no boundary in common."""
    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                n = max(1, -(-len(text) // stride))
                for at in range(0, n, 64):
                    part = range(at, min(n, at + 64))
                    cut = [text[k * stride : (k + 1) * stride + overlap] for k in part]
                    yield pa.RecordBatch.from_pydict(
                        {"_row": [row] * len(part), "n_chunks": [n] * len(part), "chunk": list(part), "text": cut}
                    )

    cut = texts.mapInArrow(chop, "_row long, n_chunks long, chunk long, text string")
    # A document's chunks go to different tasks.
    cut = cut.repartition("_row", "chunk")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                made, first = own.encode(r["text"], add_special_tokens=False), r["chunk"] * stride
                offsets, ids, text = made.offsets, made.ids, r["text"]
                sides = {"left": first, "right": first + stride}
                found = {k: boundaries(text, offsets, ids, first, at, at + overlap) for k, at in sides.items()}
                out.append({"_row": r["_row"], "n_chunks": r["n_chunks"], "chunk": r["chunk"], "n": len(ids)} | found)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(CHUNK))
    chunks = cut.mapInArrow(encode, CHUNK)
    ahead = W.partitionBy("_row").orderBy("chunk")
    # The boundaries that two neighbours share: same place, same tokens after it.
    met = F.when(F.col("follow").isNotNull(), F.expr("get(filter(right, x -> exists(follow, y -> y.at = x.at and y.next = x.next)), 0)"))
    pairs = chunks.withColumn("follow", F.lead("left").over(ahead)).withColumn("cut", met)
    back = F.lag("cut").over(ahead)
    placed = pairs.withColumn("from", back).withColumn(
        "skip", F.expr("if(`from` is null, null, get(filter(left, x -> x.at = `from`.at), 0).n)")
    )
    own = F.when(F.col("chunk") == F.col("n_chunks") - 1, F.col("n")).otherwise(F.col("cut.n"))
    own = own - F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("skip"))
    # One chunk without a boundary makes the sum of its document null.
    return placed.groupBy("_row").agg(
        F.when(F.count(own) == F.max("n_chunks"), F.sum(own)).cast("bigint").alias("n_tokens")
    )
