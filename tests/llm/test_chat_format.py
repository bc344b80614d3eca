"""Chat formatting against plain Python, an exact round trip, and rows that are large, null, tied, repeated or clash by name."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import chat_format as cf

ODD = r"\### Assistant: </turn> ok"


def rendered(turns):
    """(text, loss spans) by string functions."""
    text, loss = "", []
    for role, said in turns:
        esc = lambda v, more="": re.sub(r"\\|#(?=##)|<(?=/turn>)" + more, lambda m: "\\" + m[0], v)
        text += f"### {esc(role, '|:(?= )')}: "
        start = len(text)
        text += esc(said)
        loss += [(start, len(text))] if role == "assistant" else []
        text += "</turn>\n"
    return text, loss


def ordered(rows):
    """{conv_id: [(role, text)]} by turn, role and text, null turns first."""
    convs = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        convs.setdefault(conv, []).append((role, text))
    return convs


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    bits = ["a", "é", "😀", "#", "##", "###", "####", "</turn>", "<", "</turn", "\\", "\\\\", "\n", ": ", " "]
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "a: b", "#### x\\"]), "".join(rng.choices(bits, k=rng.randint(0, 30)))))
    out += [(50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "no turn"), (None, 1, "assistant", "no id"), (None, 0, "user", ODD), (51, 0, "assistant", "")]
    out += [(52, 0, "user", "twice"), (52, 0, "user", "twice"), (52, 0, "assistant", "tie"), (53, 0, "assistant", ODD * 4000)]
    return out + [(60, k, ["user", "assistant"][k % 2], f"{ODD} {k} é") for k in range(3000)]


@pytest.fixture(scope="module")
def turns(spark, rows):
    wide = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(wide, "conv_id long, turn int, role string, text string, loss string, part int").repartition(5)


@pytest.mark.parametrize("options", [{}, {"part_bytes": 20_000, "slice_bytes": 3000}, {"slice_bytes": 1}])
def test_rendering(turns, rows, options):
    got = {}
    for r in cf.format_chats(turns, **options).collect():
        got.setdefault(r.conv_id, []).append(r)
    want = ordered(rows)
    assert set(got) == set(want)
    for conv, said in want.items():
        parts = sorted(got[conv], key=lambda r: r.part)
        assert (len(parts) > 1) == (options.get("part_bytes", 0) > 0 and conv == 60)  # conversation 53 is one long turn
        text, loss = rendered(said)
        assert "".join(p.text for p in parts) == text and sum(p.n_turns for p in parts) == len(said)
        assert [p.text[s.start : s.end] for p in parts for s in p.loss] == [text[a:b] for a, b in loss]
        assert [t for p in parts for t in cf.read_turns(p.text)] == said
        bare = re.sub(r"\\.", "~", text, flags=re.S)
        assert bare.count("</turn>") == bare.count("### ") == len(said)


@pytest.mark.parametrize("options", [{}, {"part_bytes": 20_000, "slice_bytes": 3000}])
def test_digests(turns, rows, options):
    got = {r.conv_id: r for r in cf.read_back(cf.format_chats(turns, **options)).collect()}
    want = ordered(rows)
    assert set(got) == set(want)
    for conv, said in want.items():
        learnt = "".join(t for r, t in said if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in said), learnt)]
        assert tuple(got[conv]) == (conv, len(said), sha[0], len(learnt), sha[1], len(rendered(said)[0]))


def test_other_loss_roles_and_empty_table(turns):
    assert all(s.start < s.end for r in cf.format_chats(turns, loss_roles=("system",)).where("conv_id < 40").collect() for s in r.loss if r.text[s.start : s.end])
    assert cf.read_back(cf.format_chats(turns.limit(0))).collect() == []


@given(st.text(alphabet="#<>/turn\\: aé😀\n", max_size=60), st.text(alphabet="#<>/turn\\: aé", max_size=20))
@settings(max_examples=300, deadline=None)
def test_round_trip(text, role):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 1], pa.int64()), pa.array([0, 1], pa.int64()), pa.array([role, "assistant"]), pa.array([text, text])], ["conv_id", "turn", "role", "text"])
    out = cf.assemble(batch, ("assistant",)).to_pylist()[0]
    assert list(cf.read_turns(out["text"])) == [(role, text), ("assistant", text)]
    assert [cf.unescaped(out["text"][s["start"] : s["end"]]) for s in out["loss"]][-1] == text


def test_query_has_the_planted_conversation(spark):
    got = cf.op11_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()[0]
    said = f"user\n{ODD}\nassistant\n{ODD}\n"
    assert (got.n_turns, got.loss_chars) == (2, len(ODD))
    assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(ODD.encode()).hexdigest()
