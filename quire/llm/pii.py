"""Personal data by candidate gradient boosting, in DataFrame operations only.

Two sets of patterns find spans. The base patterns with their tests (parts of an
address, check digits, number of digits) always stand. High-recall generators
propose further spans, which may overlap them and each other: obfuscated mail addresses,
numbers with other separators, card and phone numbers of any spacing. Gradient-boosted
trees score each proposal from its format and its context.

*What the trees learn from.* Personal data: confirmed base spans, in their own context, written as only
the generators catch them (an at-sign in words, other separators, no plus). No personal
data: the same spans in the same forms with a wrong check digit, a part too large, the digits of a date or no
domain, and proposals of the texts that cannot be data of their kind (failed checks, dates and
versions, what a base span of another kind covers). All other proposals are not labelled, and only they can be added.
The score from which a kind is accepted is calibrated on spans that the trees have
not seen: the lowest at which at least ``precision`` of them are personal data.

Texts without a digit, an at-sign or a written-out one can hold no span and leave at
the first test. The others are written once with a row number; places come from
the lengths between matches, summed in a window per text and pattern, so a text with very
many matches costs no more than their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import bounded, packed
from quire.session import written

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns. A match starts where the last one ended or where its first run
#: of characters does; possessive repeats take the same text without recursion.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators with high recall.
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?: ?(?:\.|\[\.\]|,) ?[0-9]{1,4}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){11,21}+",
    "phone": r"(?<![0-9])(?:\+|00)?[(]?[0-9]{1,4}+[)]?(?:[ ()./-]{1,3}[0-9]{2,5}+){1,5}+",
}
GATE = r"[0-9@]|[(\[]at[)\]]"
PRECISION = 0.95
TREES, DEPTH = 12, 4
BINS = 200
WORDS = {
    "email": "mail|contact|write|e-mail|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr|login",
    "card": "card|visa|amex|master|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|fax|mobile|cell|telefon",
}


def matches(rows: DataFrame, kind: str, pattern: str, base: bool) -> DataFrame:
    """``row, kind, base, start, stop, hit, before, after``: matches of one pattern with their places."""
    between = F.split("text", pattern, -1)
    hits = F.regexp_extract_all("text", F.lit(pattern), 0)
    some = rows.filter(F.col("text").rlike(pattern)).select("row", between.alias("p"), hits.alias("h"))
    gaps = F.expr("transform(p, x -> struct(length(x) as n, right(x, 24) as tail, left(x, 4) as head))").alias("g")
    some = some.select("row", gaps, F.col("h").alias("h"))
    some = some.select("row", F.posexplode(F.arrays_zip("g", "h", F.expr("slice(g, 2, size(g))").alias("f"))).alias("i", "x"))
    some = some.select("row", "i", "x.*").filter("h is not null")
    up_to = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("h")
    stop = F.sum(F.col("g.n") + size).over(up_to)
    return some.select(
        "row",
        F.lit(kind).alias("kind"),
        F.lit(base).alias("base"),
        (stop - size).alias("start"),
        stop.alias("stop"),
        F.col("h").alias("hit"),
        F.col("g.tail").alias("before"),
        F.coalesce("f.head", F.lit("")).alias("after"),
    )


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    at = F.sequence(F.lit(1), F.length(digits))

    def weighed(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).try_cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(at, weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def confirmed(kind: Column, hit: Column) -> Column:
    """The test of a base match; the number of digits is tested first."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    count = F.length(digits)
    # Leading zeros do not count; more than nine other digits are above 255 without a cast.
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).try_cast("int") <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when((count >= 16) & (count <= 19), luhn(digits)).otherwise(False))
        .otherwise((count >= 8) & (count <= 15))
    )


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of each proposal as numbers."""
    hit = F.col("hit")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    kept = lambda allowed: F.length(F.regexp_replace(hit, f"[^{allowed}]", ""))
    columns = {
        "f_kind": reduce(lambda c, k: F.when(F.col("kind") == k, float(KINDS.index(k))).otherwise(c), KINDS, F.lit(-1.0)),
        "f_length": F.length("hit"),
        "f_digits": F.length(digits),
        "f_letters": kept("A-Za-z"),
        "f_dots": kept("."),
        "f_spaces": kept(" "),
        "f_hyphens": kept("-"),
        "f_slashes": kept("/,"),
        "f_brackets": kept("()"),
        "f_square": kept("\\[\\]"),
        "f_plus": F.col("hit").startswith("+"),
        "f_at": F.col("hit").contains("@"),
        "f_groups": F.size(F.split(hit, "[^A-Za-z0-9]+")),
        "f_longest": F.array_max(F.transform(F.split(hit, "[^0-9]+"), F.length)),
        "f_check": F.when((F.length(digits) >= 12) & (F.length(digits) <= 19), luhn(digits)).otherwise(False),
        "f_small": F.forall(F.filter(F.split(hit, "[^0-9]+"), lambda x: x != ""), _small),
        "f_parts": F.size(F.filter(F.split(hit, "[^0-9]+"), lambda x: x != "")),
        "f_domain": hit.rlike(DOMAIN),
        "f_date": hit.rlike(DATE),
        "f_version": hit.rlike(VERSION),
        "f_glued": F.col("before").rlike("[A-Za-z0-9._%+-]$") | F.col("after").rlike("^[A-Za-z0-9@-]"),
        "f_line": (F.col("before") == "") | F.col("before").endswith("\n"),
    }
    columns |= {f"f_word_{k}": F.lower("before").rlike(rf"(?:{w})[^A-Za-z]*$") for k, w in WORDS.items()}
    made = found.withColumns({k: v.cast("double") for k, v in columns.items()})
    return made, list(columns)


def proposals(rows: DataFrame) -> DataFrame:
    """Base spans that pass their test, and proposals with ``y``, does a base span of the kind overlap it, and ``z``, does any?"""
    base = reduce(DataFrame.unionByName, [matches(rows, k, p, True) for k, p in BASE.items()])
    base = base.filter(confirmed(F.col("kind"), F.col("hit")))
    wide = reduce(DataFrame.unionByName, [matches(rows, k, p, False) for k, p in WIDE.items()])
    found = base.unionByName(wide)
    for name, keys in (("y", ("row", "kind")), ("z", ("row",))):
        # Both windows grow row by row; one that shrinks would be computed anew for every row.
        own = W.partitionBy(*keys)
        up = own.orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)
        down = own.orderBy(F.desc("start"), F.desc("stop")).rowsBetween(W.unboundedPreceding, 0)
        earlier = F.max(F.when(F.col("base"), F.col("stop"))).over(up)
        later = F.min(F.when(F.col("base"), F.col("start"))).over(down)
        over = F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("stop"), F.lit(False))
        found = found.withColumn(name, over.cast("int"))
    return found


def _small(part: Column) -> Column:
    """A part of an address: at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).try_cast("int") <= 255)


#: What stands behind the at-sign has a dot, or a written one, before a last part that begins with a letter.
DOMAIN = r"(?:@|at[)\]]).*(?:\.|dot[)\]]) ?[A-Za-z][A-Za-z0-9-]*+$"
DATE = r"^\(?(?:(?:19|20)[0-9]{2}[ ./-]+[0-9]{1,2}[ ./-]+[0-9]{1,2}|[0-9]{1,2}[ ./-]+[0-9]{1,2}[ ./-]+(?:19|20)[0-9]{2})$"
VERSION = r"^[0-9]+(?:\.[0-9]+)+$"


def impossible() -> Column:
    """A proposal that cannot be personal data of its kind."""
    kind, hit = F.col("kind"), F.col("hit")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    count = F.length(digits)
    return (
        F.when(kind == "email", ~hit.rlike(DOMAIN))
        .when(kind == "ip", ~F.forall(F.filter(F.split(hit, "[^0-9]+"), lambda x: x != ""), _small))
        .when(kind == "card", F.when((count >= 16) & (count <= 19), ~luhn(digits)).otherwise(True))
        .otherwise((count < 8) | (count > 15) | hit.rlike(DATE) | hit.rlike(VERSION))
    )


def _of(choices: list[Column], h: Column) -> Column:
    return F.get(F.array(*choices), F.pmod(h, F.lit(len(choices))).cast("int"))


def altered() -> tuple[Column, Column]:
    """A base span written in a form that no base pattern takes, and the same form with no personal data in it."""
    kind, hit = F.col("kind"), F.col("hit")
    h = F.xxhash64("row", "kind", "start")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    at = _of([F.lit(x) for x in ("(at)", " (at) ", "[at]", " [at] ")], h)
    dot = _of([F.lit(x) for x in (".", "(dot)", " (dot) ", "[dot]")], F.shiftright(h, 8))
    local, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    gap = _of([F.lit(x) for x in (",", "[.]", " . ", " [.] ")], h)
    apart = _of([F.lit(x) for x in (".", "/", "  ", "./")], h)
    fours = lambda d: F.call_function("array_join", F.regexp_extract_all(d, F.lit("[0-9]{1,4}"), F.lit(0)), apart)
    wrong = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((F.substr(digits, F.length(digits), F.lit(1)).try_cast("int") + 1) % 10).cast("string"))
    parts = F.split(F.trim(F.regexp_replace(hit, "[^0-9]+", " ")), " ")
    # A first part of 300 to 999.
    front = F.concat(_of([F.lit(str(x)) for x in range(3, 10)], F.shiftright(h, 8)), F.right(F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lit(2)))
    large = F.concat(front, F.regexp_extract(hit, r"\..*", 0))
    spaced = _of([F.lit(x) for x in ("-", ".", " ", "/")], h)
    phone = F.concat(_of([F.lit(x) for x in ("", "00", "")], F.shiftright(h, 8)), F.call_function("array_join", parts, spaced))
    phone = F.when(F.pmod(h, F.lit(3)) == 0, F.ltrim(F.regexp_replace(hit, r"^\+", ""))).otherwise(phone)
    day = F.call_function("concat_ws", spaced, F.concat(F.lit("20"), F.substr(digits, F.lit(1), F.lit(2))), F.lit("07"), F.substr(digits, F.lit(3), F.lit(2)))
    good = (
        F.when(kind == "email", F.concat(local, at, F.replace(domain, F.lit("."), dot)))
        .when(kind == "ip", F.call_function("array_join", F.split(hit, r"\."), gap))
        .when(kind == "card", fours(digits))
        .otherwise(phone)
    )
    bad = (
        F.when(kind == "email", F.concat(local, at, F.substring_index(domain, ".", 1)))
        .when(kind == "ip", F.call_function("array_join", F.split(large, r"\."), gap))
        .when(kind == "card", fours(wrong))
        .otherwise(day)
    )
    return good, bad


def labelled(found: DataFrame) -> DataFrame:
    """What the trees learn from, ``y`` for personal data: every row that has a label."""
    good, bad = altered()
    both = found.filter("base").withColumn("x", F.explode(F.array(F.struct(F.lit(1).alias("y"), good.alias("hit")), F.struct(F.lit(0).alias("y"), bad.alias("hit")))))
    both = both.drop("y", "z", "hit", "base").select("*", "x.*").drop("x")
    # Only what a generator takes whole can be met.
    whole = reduce(lambda c, k: F.when(F.col("kind") == k, F.col("hit").rlike(f"^(?:{WIDE[k]})$")).otherwise(c), KINDS, F.lit(False))
    known = found.filter(~F.col("base") & (F.col("y") == 0) & ((F.col("z") == 1) | impossible())).drop("z", "base").withColumn("y", F.lit(0))
    rows = both.filter(whole).unionByName(known)
    # Rows of one text are in the same part.
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(4)))


def accepted(found: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Proposals without a label whose score reaches the threshold of their kind."""
    known, names = features(labelled(found))
    known = written(known, "labelled")
    seen = {(r.y, r.held) for r in known.select("y", (F.col("part") == 0).alias("held")).distinct().collect()}
    new = found.filter(~F.col("base") & (F.col("z") == 0)).filter(~impossible())
    if not {(0, False), (1, False), (1, True)} <= seen:
        return new.filter("false")
    gather = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=1)
    model = trees.fit(gather.transform(known.filter("part <> 0")))

    def scored(df: DataFrame) -> DataFrame:
        out = model.transform(gather.transform(df)).withColumn("score", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", "prediction")

    # Calibration: personal data and all unseen spans from each score upwards.
    bins = scored(known.filter("part = 0")).groupBy("kind", F.floor(F.col("score") * BINS).alias("bin"))
    bins = bins.agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("all"))
    above = W.partitionBy("kind").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("p", F.sum("good").over(above) / F.sum("all").over(above))
    least = {r.kind: r.bin / BINS for r in bins.filter(F.col("p") >= precision).groupBy("kind").agg(F.min("bin").alias("bin")).collect()}
    threshold = reduce(lambda c, k: F.when(F.col("kind") == k, least[k]).otherwise(c), least, F.lit(2.0))
    return scored(features(new)[0]).filter(F.col("score") >= threshold).select(new.columns)


def personal_data(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``_doc, base, spans``: the row with its base spans and all its spans.

    Needs ``text``; other columns stay in ``_doc``, all or those to ``keep``. Spans are
    structs ``kind`` (its place in ``KINDS``), ``start``, ``stop`` in code points, sorted. Null counts as
    empty; texts without spans have empty arrays. Repeated rows have the same spans. Added spans overlap
    no base span. Without base spans to learn from (some of them in the quarter of the texts kept for
    calibration) nothing is added. An empty table gives an empty table.
    """
    rows = packed(docs, "text", keep=keep)
    none = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>")
    plain = rows.filter(~F.coalesce(F.col("text").rlike(GATE), F.lit(False)))
    plain = plain.select("_doc", none.alias("base"), none.alias("spans"))
    held = written(rows.filter(F.col("text").rlike(GATE)).select("_doc", "text", F.monotonically_increasing_id().alias("row")), "texts")
    found = written(proposals(held.select("row", "text")), "proposals")
    place = reduce(lambda c, k: F.when(F.col("kind") == k, KINDS.index(k)).otherwise(c), KINDS, F.lit(-1))
    span = F.struct(place.cast("int").alias("kind"), F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))
    spans = found.filter("base").unionByName(accepted(found))
    spans = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    marked = held.join(bounded(written(spans, "spans")), "row", "left")
    return plain.unionByName(marked.select("_doc", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")))
