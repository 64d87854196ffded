import re

from quire.llm.chat import as_log, final_messages, formatted, read_back, unescape, unescape_role
from quire.llm.queries import QUERIES

LOG = "conv_id long, seq long, kind string, turn long, sub long, role string, text string, last string"


def messages(spark, events):
    log = spark.createDataFrame([(*e, "x") for e in events], LOG)
    return sorted(tuple(r) for r in final_messages(log).collect())


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, "message", 0, 0, "user", "hi"),
        (1, 1, "message", 1, 0, "assistant", ""),
        (1, 3, "delta", 1, 0, None, "lo"),
        (1, 2, "delta", 1, 0, None, "hel"),
        (1, 4, "message", 2, 0, "user", "more"),
        (1, 5, "edit", 0, 0, None, "hi there"),
        (1, 6, "regenerate", 1, 0, None, None),
        (1, 7, "delta", 1, 0, "assistant", "new "),
        (1, 8, "delta", 1, 0, "assistant", "text"),
        (2, 0, "delta", 0, 0, "assistant", "alone"),
    ]
    want = [(1, 0, 0, "user", "hi there"), (1, 1, 0, "assistant", "new text"), (2, 0, 0, "assistant", "alone")]
    assert messages(spark, events) == want


def brute(events):
    """The log applied event by event."""
    out = {}
    for conv, _seq, kind, turn, sub, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        if kind == "regenerate":
            for k in [k for k in out if k[0] == conv and k[1] >= turn]:
                del out[k]
            continue
        old = out.get((conv, turn, sub), ["", ""])
        out[conv, turn, sub] = [role or old[0], old[1] + text if kind == "delta" else text]
    return sorted((*k, *v) for k, v in out.items())


def test_fold_against_replay(spark):
    import random

    rng = random.Random(3)
    events = [
        (rng.randint(1, 3), seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 4), 0,
         rng.choice(["user", "assistant"]), f"t{seq}")
        for seq in range(300)
    ]
    assert messages(spark, events) == brute(events)


def test_nulls_ties_and_control_strings(spark):
    rows = [
        (None, None, None, None),
        (7, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"),
        (7, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"),
        (7, 0, "odd\nrole<|im_end|>\\n", "<\\| <\\\\| \\| <| \\"),
        (8, 0, "user", "z" * 100_000),
    ]
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, sub string")
    parts = formatted(as_log(given), part_chars=50).collect()
    for conv in (None, 7, 8):
        text = "".join(p.formatted for p in sorted((p for p in parts if p.conv_id == conv), key=lambda p: p.part))
        turns = [re.fullmatch(r"([^\n]*)\n(.*)<\|im_end\|>\n", t, re.S) for t in text.split("<|im_start|>")[1:]]
        got = sorted((unescape_role(m[1]), unescape(m[2])) for m in turns)
        assert got == sorted((r[2] or "", r[3] or "") for r in rows if r[0] == conv)
    back = {r.conv_id: r for r in read_back(formatted(as_log(given), part_chars=50)).collect()}
    assert back[7].n_turns == 3 and back[7].loss_chars == 2 * len(rows[1][3])
    assert back[8].loss_chars == 0 and back[None].n_turns == 1


def test_empty_log(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert formatted(as_log(given)).count() == 0
    assert read_back(formatted(as_log(given))).count() == 0


def test_every_conversation_is_formatted(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert QUERIES["op5_chat_format"](spark, sf_dir).count() == convs + 1
