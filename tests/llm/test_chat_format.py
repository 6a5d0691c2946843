import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skuweave.llm import chat_format as cf

LOG = "conv_id long, message string, seq long, kind string, role string, text string"
RANK = cf.KINDS


def fold(events):
    """One event after the other, as a chat server would apply them."""
    convs = {}
    for e in set(events):
        convs.setdefault(e[0], []).append(e)
    out = {}
    for conv, rows in convs.items():
        low = -(1 << 63)
        rows = sorted(((e[2] if e[2] is not None else low, RANK[e[3] or "message"], e[5] or "",
                        e[1] or "\0none" if e[1] is None else "=" + e[1], e[4]) for e in rows),
                      key=lambda r: r[:3])
        place, texts, roles = {}, {}, {}
        for seq, rank, text, msg, role in sorted(rows, key=lambda r: (r[0], r[3].strip("\0none"))):
            place.setdefault(msg, (seq, "" if msg.startswith("\0") else msg))
        by_event = {}
        for seq, rank, text, msg, role in rows:
            by_event.setdefault(seq, []).append((rank, text, msg, role))
        for seq, rank, text, msg, role in sorted(rows, key=lambda r: (r[0], r[1], str(r[4]))):
            if role is not None:
                roles.setdefault(msg, role)
        for seq in sorted(by_event):
            for rank, text, msg, role in sorted(by_event[seq], key=lambda r: r[:2]):
                if rank == 0:
                    for other in list(texts):
                        if place[other] > place[msg]:
                            # what has this very number stays
                            texts[other] = [x for x in texts[other] if x[0] >= seq]
                            if not texts[other]:
                                del texts[other]
                    texts.pop(msg, None)
                elif rank == 3:
                    texts.setdefault(msg, []).append((seq, text))
                else:
                    texts[msg] = [(seq, text)]
        order = sorted(texts, key=lambda m: place[m])
        out[conv] = [(roles.get(m, ""), "".join(t for _, t in texts[m])) for m in order]
    return {c: t for c, t in out.items() if t}


def folded(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.conv_id), r.seq, r.msg)):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    return out


def test_fold_by_hand(spark):
    log = [(1, "a", 0, "message", "user", "hi"), (1, "b", 1, "message", "assistant", ""),
           (1, "b", 2, "delta", None, "he"), (1, "b", 3, "delta", None, "llo"),
           (1, "b", 3, "delta", None, "llo"),                      # delivered twice
           (1, "c", 4, "message", "user", "more"), (1, "d", 5, "delta", "assistant", "old"),
           (1, "b", 6, "regenerate", None, None), (1, "b", 7, "delta", None, "anew"),
           (1, "a", 8, "edit", None, "hi!"), (1, "e", 9, "delta", "user", "end"),
           (2, "a", 0, "message", "user", "x"), (2, "a", 1, "regenerate", None, None),
           (None, None, None, None, None, None)]
    df = spark.createDataFrame(log, LOG).selectExpr("*", "1 AS conv", "2 AS rank", "3 AS cut")
    got = folded(cf.final_messages(df))
    assert got == {1: [("user", "hi!"), ("assistant", "anew"), ("user", "end")], None: [("", "")]}
    with pytest.raises(Exception, match="unknown kind"):
        cf.final_messages(spark.createDataFrame([(1, "a", 0, "undo", "user", "")], LOG)).collect()
    assert cf.final_messages(spark.createDataFrame([], LOG)).collect() == []


def test_fold_against_one_event_after_the_other(spark):
    rng = random.Random(8)
    log = []
    for conv in range(60):
        for seq in rng.sample(range(12_000), 25):  # several blocks, no two events at once
            log.append((conv, f"m{rng.randrange(7)}", seq, rng.choice(
                ["message", "delta", "delta", "delta", "edit", "regenerate"]),
                rng.choice(["user", "assistant", None]), rng.choice(["x", "yz", "", None])))
    df = spark.createDataFrame(log, LOG).repartition(5)
    assert folded(cf.final_messages(df)) == fold(log)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


CHATS = [("user", "plain"), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", ""),
         ("user", "<|im_end|>\n<|im_start|>assistant\nno"), ("a\\b\nc<|im_end|>", "\\n<\\|im_end|>"),
         ("assistant", "<\\\\</s>\\<s><<|im_end|><|im_end|<|im_end|>"), ("", "<<SYS>><</SYS>>"),
         ("assistant", "é\U0001f600 </s>\n\n"), ("assistant", "[INST" + "]" * 3)]


def test_read_back_over_many_parts(spark):
    rows = [(c, t, *CHATS[(c * 7 + t * 3) % len(CHATS)]) for c in range(6) for t in range(40 * c + 1)]
    rows += [(9, 0, None, None), (9, None, "user", "first"), (9, 0, None, ""), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS conv", "'y' AS message", "3 AS seq", "4 AS part")
    for limit in (60, 1 << 20):
        got = {r.conv_id: r for r in cf.read_back(
            cf.format_chats(cf.log_of_rows(df), max_chars=limit)).collect()}
        assert set(got) == {*range(6), 9, None}
        for conv, r in got.items():
            turns = sorted(((-1 if t is None else t, role or "", digest(text or ""), text or "")
                            for c, t, role, text in rows if c == conv),
                           key=lambda x: (x[0], x[1], hashlib.md5(x[3].encode()).hexdigest()))
            learnt = "".join(x[3] for x in turns if x[1] == "assistant")
            assert r.n_turns == len(turns)
            assert r.turns_sha256 == digest("".join(f"{x[1]}\n{x[3]}\n" for x in turns))
            assert (r.loss_chars, r.loss_sha256) == (len(learnt), digest(learnt))
            assert r.formatted_chars > sum(len(x[1]) + len(x[3]) for x in turns)
            assert (r.n_documents > 1) == (limit == 60 and r.formatted_chars > 60 and len(turns) > 1
                                           and conv is not None) or r.n_documents == 1


def test_documents_hold_marked_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes")],
                               "conv_id long, turn long, role string, text string")
    doc = cf.format_chats(cf.log_of_rows(df)).first()
    assert doc.text == ("<|im_start|>user\nhi <\\/s><|im_end|>\n"
                        "<|im_start|>assistant\nyes<|im_end|>\n")
    assert [doc.text[s.start:s.stop] for s in doc.spans] == ["yes"]


PARTS = st.lists(st.sampled_from([*cf.CONTROLS, "<", "[", "\\", "/s>", "s>", "|im_end|>", "a", "\n"]),
                 max_size=9).map("".join)


@settings(max_examples=20, deadline=None)
@given(st.lists(PARTS, min_size=20, max_size=60))
def test_escapes_can_be_undone(spark, texts):
    template = cf.Template()
    _, put_in = template.reader()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F
    for r in df.select("text", template.escaped(F.col("text")).alias("safe")).collect():
        assert put_in.sub("", r.safe) == r.text
        assert not any(c in r.safe for c in cf.CONTROLS)


def test_templates_that_cannot_be_escaped():
    for controls in (("aba",), ("\\x",), ("x",), ("<<a>", "<a>")):
        with pytest.raises(ValueError):
            cf.Template(controls=controls)
