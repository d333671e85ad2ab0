"""Personal data in disguise: spans in source characters against disguises whose place is known, and hostile texts."""

import random
import time

import pytest

from terraspark.llm import pii

ALIKE = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "1": "１", "4": "４", "@": "＠", ".": "．"}
DIGITS = "zero one two three four five six seven eight nine".split()


def disguise(rng, plain, kind):
    """A text that stands for ``plain``, other than it."""
    out = []
    for c in plain:
        if kind == "email" and c == "@":
            out.append(rng.choice([" [at] ", "(at)", " {at} ", "[ @ ]", "＠"]))
        elif kind == "email" and c == ".":
            out.append(rng.choice([".", " [dot] ", "(dot)", "．"]))
        elif kind == "phone" and c.isdigit() and len(out) > 1:
            out.append(" " + DIGITS[int(c)])
        elif c in ALIKE and rng.random() < 0.4:
            out.append(ALIKE[c])
        else:
            out.append(c + ("​" if kind != "phone" and rng.random() < 0.1 else ""))
    return "".join(out).strip("​")


@pytest.mark.parametrize(("kind", "plain"), [("email", "joe.poe@example.com"), ("ip", "192.168.4.1"), ("card", "4785380592391139"), ("phone", "+15551234567")])
def test_added_spans_cover_the_disguise(kind, plain):
    rng = random.Random(kind)
    for _ in range(300):
        d = disguise(rng, plain, kind)
        if d == plain:
            continue
        left, right = (" ".join(rng.choice(["был", "über", "word", "\U0001f600", "ß"]) for _ in range(rng.randint(0, 5))) for _ in range(2))
        text = f"{left} | {d} | {right}"
        start = len(left) + 3
        base = pii.find(text)
        if base[kind]:  # the disguise left a shorter plain one, which stays as it is
            continue
        assert pii.find_added(text, base)[kind] == [(start, start + len(d))], text


def test_rewritten_maps_back_by_brute_force():
    """Every character of a text after several rounds of replacements knows where it came from."""
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25)))
        r, origin = pii.Rewritten(text), [(i, i + 1) for i in range(len(text))]
        for _ in range(3):
            changes, at = [], 0
            while at < len(r.text):
                a = at + rng.randint(0, 4)
                b = a + rng.randint(1, 3)
                if b > len(r.text):
                    break
                changes.append((a, b, rng.choice(["", "X", "YZ"])))
                at = b
            want, done, now = [], 0, ""
            for a, b, new in changes:
                want += origin[done:a] + [(origin[a][0], origin[b - 1][1])] * len(new)
                now += r.text[done:a] + new
                done = b
            want += origin[done:]
            now += r.text[done:]
            r.replace(changes)
            assert r.text == now
            origin = want
            assert [r.back(i, i + 1) for i in range(len(now))] == origin


@pytest.mark.parametrize(
    "text",
    ["0" * 5000 + ".1.2.3", "1" * 5000 + ".1.2.3", "1.2.3." + "9" * 100000, " " * 1000000 + "a [at] b [dot] com" + " " * 1000000, "a at b" + " " * 500000 + "dot com", "x @ a" + " " * 500000 + ". com", "[ " * 300000 + "at]", "(at)" * 100000, "+1" + " " * 1000000, "a.a." * 200000 + "@ dot ", "x @ y.com " * 100000, "x at y dot com " * 50000 + "x @ y . com " * 50000],
)
def test_hostile_texts_take_linear_time(text):
    began = time.time()
    base = pii.find(text)
    pii.find_added(text, base)
    assert time.time() - began < 20
    if text.startswith("0000"):
        assert base["ip"] == [(0, 5006)]


def test_table_with_clashing_columns(spark):
    rows = [(None, None, 1, "x"), (1, "", 2, "x"), (1, "a@b.co", 3, "x"), (1, "a@b.co", 3, "x"), (2, "0" * 5000 + ".1.2.3", 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email long, spans string")
    got = sorted(pii.find_pii(df).collect(), key=str)
    assert sorted(r["n_email"] for r in got) == [0, 0, 0, 1, 1]
    assert pii.mask_pii(df, length_col=None).columns == df.columns and pii.mask_pii(df).count() == 5
