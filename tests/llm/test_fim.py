"""Fill-in-middle against a plain version of its contract."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terraspark.llm.fim import UNITS, fill_in_middle, restore

SCHEMA = "doc_id long, text string, units string, output string, _text string"
FIND = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ ]* |[^ ]+", "char": r"(?s)."}


def expected(key, text, unit="line", salt=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(FIND[unit], text)
    h = hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate
    form = "plain" if plain else "spm" if h[3] % 100 < spm else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(units), form, None if plain else len(p), None if plain else len(m), digest(out), digest(text), out)


def texts():
    r = random.Random(11)
    fixed = [None, "", "a", "a\n", "\n\n", "a\x00b\nc", "é漢\n😀́x\r\ny", "x<P>\n", "a<S", "<M", "S>\n<", "'\"\\\n%s {0}", "line\n" * 20_000, "long " * 100_000]
    return fixed + ["".join(r.choice("ab\n <PSM>é😀\r\x00") for _ in range(r.randint(0, 60))) for _ in range(150)]


@pytest.mark.parametrize("unit", list(UNITS))
def test_forms_cuts_and_digests(spark, unit):
    given = [(i, t, "u", "o", "t") for i, t in enumerate(texts())]
    given += [(None, "a\nb\nc\n", "u", "o", "t"), (5, "again\nand again", "u", "o", "t"), given[7], given[7]]
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = fill_in_middle(docs, unit=unit)
    back = found.withColumn("back", F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256)).collect()
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"], r["output"]) for r in back)
    assert got == sorted((repr(i), *expected(i, t, unit)) for i, t, *_ in given)
    assert all(r["back"] == r["restored_sha256"] for r in back)


def test_rate_and_share_of_forms(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\nd") for i in range(400)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fill_in_middle(docs, rate=30, spm=100, salt=3).collect()}
    assert all((rows[i]["n"], rows[i]["form"]) == expected(i, "a\nb\nc\nd", salt=3, rate=30, spm=100)[:2] for i in rows)
    assert 60 < sum(r["form"] == "spm" for r in rows.values()) < 180 and not any(r["form"] == "psm" for r in rows.values())


def test_empty_table_and_marks_that_could_arise(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(docs).count() == 0
    assert fill_in_middle(docs, texts=False).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=marks)
