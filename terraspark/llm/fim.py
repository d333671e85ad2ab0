"""Fill-in-middle: a text is cut into prefix, middle and suffix, and the middle goes last.

Every Arrow batch is registered in a DuckDB connection of the task, which does all
the work on it in SQL: units by ``regexp_extract_all``, cuts by ``list_slice``, texts
by ``array_to_string`` and digests by ``sha256``. No row is touched in Python.

Where a text is cut and in which form it goes is drawn from the sha256 of
``<salt>:<id>``, so a task that runs again gives the same rows.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle,
``plain`` the text as it was. A text that is null, empty or holds one of the three
marks stays plain, so that every output can be turned back (``restore``). A null id
draws as the empty string. Every row gives one row; columns beside the id and the text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspark.llm.common import portions

#: What a text is cut into. The matches of a pattern, put together, are the whole text.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ ]* |[^ ]+", "char": r"(?s)."}
MARKS = ("<P>", "<S>", "<M>")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plan_sql(unit: str = "line", salt: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> str:
    """DuckDB SQL over ``batch(_id, _key, _text)``: one row a document with its form, cuts, output and digests."""
    p, s, m = map(_quoted, marks)
    draw = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT"
    piece = lambda first, last: f"array_to_string(list_slice(units, {first}, {last}), '')"
    return f"""
    WITH drawn AS (
      SELECT _id, coalesce(_text, '') AS text, sha256('{salt}:' || coalesce(_key, '')) AS h FROM batch),
    cut AS (
      SELECT _id, text, h, regexp_extract_all(text, {_quoted(UNITS[unit])}) AS units,
        text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {rate} AS stays FROM drawn),
    placed AS (
      SELECT _id, text, units, len(units)::BIGINT AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
        CASE WHEN stays THEN 'plain' WHEN {draw(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parts AS (
      SELECT _id, text, n, form,
        CASE WHEN form <> 'plain' THEN {piece(1, "least(a, b)::BIGINT")} END AS prefix,
        CASE WHEN form <> 'plain' THEN {piece("least(a, b)::BIGINT + 1", "greatest(a, b)::BIGINT")} END AS middle,
        CASE WHEN form <> 'plain' THEN {piece("greatest(a, b)::BIGINT + 1", "n")} END AS suffix FROM placed),
    made AS (
      SELECT _id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parts),
    undone AS (
      SELECT *, split_part(output, {m}, 1) AS head, substr(output, length(split_part(output, {m}, 1)) + {len(marks[2]) + 1}) AS tail FROM made)
    SELECT _id, n, form, prefix_chars, middle_chars, output, sha256(output) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN substr(split_part(head, {s}, 1), {len(marks[0]) + 1}) || tail || split_part(head, {s}, 2)
        ELSE split_part(head, {p}, 2) || tail || substr(split_part(head, {p}, 1), {len(marks[1]) + 1}) END) AS restored_sha256
    FROM undone"""


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", salt: int = 7, rate: int = 100, spm: int = 50,
    marks: tuple[str, str, str] = MARKS, texts: bool = True, threads: int = 1,
) -> DataFrame:
    """(id, n long, form, prefix_chars long, middle_chars long, output_sha256, restored_sha256, output) for every row.

    unit: what ``n`` counts and cuts fall between (``UNITS``). rate: hundredths of the texts that
    are turned, spm: hundredths of those in the form spm. texts=False leaves the output itself out,
    so that only digests come back from the tasks.
    """
    if len(set(marks)) < 3 or any(not x for x in marks):
        raise ValueError("three different marks are needed")
    if any(x in y for x in marks for y in marks if x != y) or any(x[:k] == y[-k:] for x in marks for y in marks for k in range(1, min(len(x), len(y)))):
        raise ValueError("a mark could arise where another one meets the text")
    sql = plan_sql(unit, salt, rate, spm, marks)
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if texts else [])]
    sql = f"SELECT _id, {', '.join(names)} FROM ({sql})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": threads}) as con:
            for batch in batches:
                for part in portions(batch, 2):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    kind = docs.schema[id_col].dataType.simpleString()
    types = {"n": "long", "prefix_chars": "long", "middle_chars": "long"}
    fields = ", ".join(f"{c} {types.get(c, 'string')}" for c in names)
    found = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_key"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {fields}")
    return found.withColumnRenamed("_id", id_col)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from. No text of the forms psm and spm held a mark."""
    p, s, m = marks
    after = lambda c, mark: F.substring_index(c, mark, -1)
    head, middle = F.substring_index(output, m, 1), after(output, m)
    psm = F.concat(after(F.substring_index(head, s, 1), p), middle, after(head, s))
    spm = F.concat(after(head, p), middle, after(F.substring_index(head, p, 1), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
