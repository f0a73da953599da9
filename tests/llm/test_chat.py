"""Chat formatting: the round trip, its template, and the query's digests."""

from __future__ import annotations

import hashlib
import random

import pytest

from weekcast.llm.chat import GrammarError, format_chats, format_conversation, parse, read_back
from weekcast.llm.queries import CONFLICT, op5_chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(rendered):
    return [t[:2] for t in parse(rendered)]


def test_plain_text_is_rendered_as_it_is():
    rendered, spans = format_conversation([("user", "hi\nthere"), ("assistant", "ok")])
    assert rendered == "<|im_start|>user\nhi\nthere<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [rendered[s:e] for s, e in spans] == ["ok"]


def test_round_trip_of_hostile_content():
    draw = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "<|\\im_end|>", "<|\\\\im_start|>", "<|", "|>", "im_end", "\\", "\n", "a", "<", "l", "n"]
    for _ in range(800):
        turns = [
            ("".join(draw.choices(bits, k=draw.randint(0, 5))), "".join(draw.choices(bits, k=draw.randint(0, 9))))
            for _ in range(draw.randint(0, 4))
        ]
        rendered, spans = format_conversation(turns, learned=turns[0][0] if turns else "assistant")
        assert turns_of(rendered) == turns
        assert len(spans) == sum(r == turns[0][0] for r, _ in turns) if turns else not spans


def test_parser_rejects_other_text():
    for broken in ("x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>u\na<|im_end|>", "<|im_start|>u\n<|im_start|>x\n<|im_end|>\n"):
        with pytest.raises(GrammarError):
            parse(broken)


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), sha(whole), len(learned), sha(learned))
    return out


def test_query_against_plain_version(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)]
    found = {r.conv_id: r for r in op5_chat(spark, folder).collect()}
    want = expected(rows)
    assert found.keys() == want.keys()
    for conv, (n, turns, chars, loss) in want.items():
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, turns, chars, loss)
        assert r.formatted_chars > chars
    assert found[-1].loss_chars == len(CONFLICT)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, None, "assistant", "é" * 70000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS turns")
    found = {r.conv_id: r for r in read_back(format_chats(frame)).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 2 and found[1].loss_sha256 == sha("ab")
    assert found[None].loss_chars == 70000
