"""Fill-in-middle transformation with counted quantifiers. DataFrame operations only.

A text is a run of units (code points, unless the caller gives another unit pattern).
`regexp_count` gives their number n, two positions a <= b are drawn from the row's id, and one
pattern made for the row, unit{a}+ unit{b-a}+ and the rest, cuts prefix, middle and suffix in
a single match. The quantifiers are possessive: each group takes exactly its units, without
backtracking or a stack that grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.rows import table

CODE_POINT = r"(?s:.)"
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
STRIDE = 1024


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """Units that adjoin each other from the start of `text`, counted by STRIDE first.

    Counting in strides keeps a list of text / STRIDE matches instead of one entry per unit.
    """
    run = f"(?:{unit}){{{STRIDE}}}+"
    rest = F.regexp_replace(text, f"\\A(?:{run})++", "")
    strides = F.regexp_count(text, F.lit(f"\\G{run}")).cast("bigint")
    return strides * STRIDE + F.regexp_count(rest, F.lit(f"\\G(?:{unit})"))


def draws(key: Column) -> list[Column]:
    """Eight numbers of 32 bits: the 8-digit groups of the hex SHA-256 of `key`."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(8)]


def cut_pattern(prefix: Column, middle: Column, unit: str = CODE_POINT) -> Column:
    """The pattern of one row: `prefix` units, `middle` units and the rest as its three groups."""
    return F.concat(F.lit(f"\\A((?:{unit}){{"), prefix.cast("string"), F.lit(f"}}+)((?:{unit}){{"), middle.cast("string"), F.lit("}+)((?s:.*+))\\z"))


def replaced(text: Column, pattern: Column, by: str) -> Column:
    return F.call_function("regexp_replace", text, pattern, F.lit(by))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, salt: str = "1:",
              rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(row, n, form, prefix_units, middle_units, output) for every row of `docs`; `row` holds its columns.

    `rate` percent of the rows are transformed, `spm_rate` percent of those with the suffix
    first; both, like the cuts, follow from the SHA-256 of `salt` and the id, so repeated ids
    are cut alike if their texts are. A null id draws from the salt alone. A null text counts
    as empty; empty texts and texts that hold a marker stay plain, with null positions. What
    follows the last unit (units must adjoin from the start) belongs to the suffix. Columns
    of `docs` may have any name, as they stay inside `row`. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(docs[text_col], F.lit(""))
    held = docs.select(row, text.alias("text"), F.concat(F.lit(salt), F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("key"))
    h = draws(F.col("key"))
    counted = held.select("row", "text", unit_count(F.col("text"), unit).alias("n"), F.array(*h[:4]).alias("h"))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(F.col("text"), F.lit(m))
    a, b = (F.get("h", F.lit(k)) % (F.col("n") + 1) for k in (0, 1))
    plain = (F.col("text") == "") | marked | (F.get("h", F.lit(2)) % 100 >= rate)
    form = F.when(plain, PLAIN).when(F.get("h", F.lit(3)) % 100 < spm_rate, SPM).otherwise(PSM)
    cut = counted.select("row", "text", "n", form.alias("form"), F.least(a, b).alias("a"), (F.greatest(a, b) - F.least(a, b)).alias("m"))
    pattern = cut_pattern(F.col("a"), F.col("m"), unit)
    p, s, m = MARKERS
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(
        F.col("form") == PSM, replaced(F.col("text"), pattern, f"{p}$1{s}$3{m}$2")).otherwise(
        replaced(F.col("text"), pattern, f"{s}$3{p}$1{m}$2"))
    shown = F.col("form") != PLAIN
    return cut.select("row", "n", "form", F.when(shown, F.col("a")).alias("prefix_units"), F.when(shown, F.col("m")).alias("middle_units"),
                      output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers are found from the left; a cut text holds none of its own."""
    p, s, m = MARKERS
    psm = F.regexp_replace(output, f"(?s)\\A{p}(.*?){s}(.*?){m}(.*+)\\z", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{s}(.*?){p}(.*?){m}(.*+)\\z", "$2$3$1")
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(table(spark, folder, "documents"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(g, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(g, 9, 8))::BIGINT % (n + 1) AS y,
             ('0x' || substr(g, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(g, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
