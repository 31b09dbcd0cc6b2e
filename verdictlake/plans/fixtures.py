"""Inputs derived from the given tables, the same in Spark and in the oracle.

The tables hold conversations but no claims, judgments or annotations; these
views make them from the assistant turns by arithmetic on their keys. Each view
reads its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.scale import apply_settings

# Expressions that read the same in both engines.
JUDGMENT_COLUMNS = """conv_id, turn, claim_idx, claim_id, h, m,
  CASE WHEN m % 17 = 0 THEN 'Yes' WHEN m % 19 = 0 THEN 'Unknown' ELSE 'No' END AS verification_error,
  CASE WHEN m % 5 = 0 THEN 'No. Not found' WHEN m % 11 = 0 THEN 'N/A. Abstention' WHEN m % 23 = 0 THEN 'Unknown' ELSE 'Yes. Matches record' END AS reference_grounding,
  CASE WHEN m % 5 = 0 OR m % 7 = 0 THEN 'No. Not supported' WHEN m % 11 = 0 THEN 'N/A. Abstention' ELSE 'Yes. Supported' END AS content_grounding,
  CASE WHEN m % 29 = 0 THEN 'Unknown' WHEN m % 5 = 0 OR m % 7 = 0 THEN 'Yes' ELSE 'No' END AS hallucination,
  CASE WHEN m % 11 = 0 THEN 'Yes' ELSE 'No' END AS abstention,
  CASE m % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'install' ELSE 'function_call' END AS element_type,
  m % 4 = 0 AS hallucinated_import_detected, m % 5 = 0 AS hallucinated_install_detected, m % 7 = 0 AS hallucinated_function_usage_detected,
  m % 6 = 0 AS input_use_fallback, m % 12 = 0 AS judge_used_websearch_fallback, m % 9 = 0 AS snippets_only"""

PAYLOAD_COLUMNS = """conv_id, turn, claim_idx, claim_id, h, claim_text,
  CASE WHEN h % 37 = 0 THEN 'Unknown' WHEN h % 41 = 0 THEN '' ELSE claim_text END AS claimed_content,
  CASE WHEN h % 4 = 0 THEN concat('Cite ', claim_id, ' (2020)') ELSE '' END AS full_citation,
  CASE WHEN h % 3 = 0 THEN '' ELSE concat('t ', CAST(h % 131 AS VARCHAR(20))) END AS claimed_title,
  CASE WHEN h % 5 = 0 THEN '' ELSE concat('author ', CAST(h % 17 AS VARCHAR(20))) END AS claimed_authors,
  CASE WHEN h % 6 = 0 THEN '' ELSE CAST(1990 + h % 30 AS VARCHAR(20)) END AS claimed_year,
  CASE WHEN h % 7 = 0 THEN concat('https://ex.org/', CAST(h % 53 AS VARCHAR(20)), CASE WHEN h % 2 = 0 THEN '.pdf' ELSE '' END) WHEN h % 7 = 1 THEN 'not a url' ELSE '' END AS claimed_url,
  CASE h % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'statute' ELSE 'article' END AS type,
  claim_text AS content,
  CASE WHEN h % 9 = 0 THEN 'Unknown' WHEN h % 10 = 0 THEN '' ELSE concat('ref ', CAST(h % 71 AS VARCHAR(20))) END AS reference_name,
  CASE WHEN h % 4 = 1 THEN '' ELSE concat('held ', CAST(h % 29 AS VARCHAR(20))) END AS holding_or_description,
  CASE WHEN h % 8 = 3 THEN 'Unknown' ELSE concat('body ', CAST(h % 13 AS VARCHAR(20))) END AS authority,
  CASE h % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'install' WHEN 2 THEN 'function_call' ELSE 'other' END AS element_type,
  CASE h % 8 WHEN 0 THEN 'numpy' WHEN 1 THEN 'cv2' WHEN 2 THEN 'PIL ' WHEN 3 THEN 'sklearn' WHEN 4 THEN 'yaml' WHEN 5 THEN 'foolib' WHEN 6 THEN 'barlib' ELSE 'bs4' END AS package_name,
  CASE h % 4 WHEN 0 THEN 'import lib' WHEN 1 THEN concat('pip install lib', CASE WHEN h % 6 = 1 THEN '==1.0' ELSE '' END) WHEN 2 THEN concat('lib.mod.fn', CAST(h % 5 AS VARCHAR(20)), '(x)') ELSE '' END AS code_snippet,
  CASE WHEN h % 12 = 2 THEN 'named_fn' ELSE '' END AS function_name,
  CASE conv_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Scala' WHEN 2 THEN 'Elixir' ELSE 'R' END AS language"""

META_COLUMNS = """conv_id,
  CASE conv_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Scala' WHEN 2 THEN 'Elixir' ELSE 'R' END AS language,
  CASE WHEN conv_id % 10 = 9 THEN NULL ELSE (conv_id * 37) % 2000 END AS cited_by_count,
  concat('paper ', CAST(conv_id % 60 AS VARCHAR(20))) AS paper_title,
  concat('m', CAST(conv_id % 5 AS VARCHAR(20))) AS model_name,
  CASE conv_id % 3 WHEN 0 THEN 'research_questions' WHEN 1 THEN 'legal_cases' ELSE 'medical_guidelines' END AS task"""

ANNOTATION_COLUMNS = """conv_id, turn, claim_idx, claim_id, h,
  CASE WHEN (h * {a} + {b}) % 8 < 2 THEN 'no' WHEN (h * {a} + {b}) % 8 = 2 THEN '' ELSE 'yes' END AS ref,
  CASE WHEN (h * {a} + {b}) % 9 < 2 THEN 'no' WHEN (h * {a} + {b}) % 9 = 2 THEN '' ELSE 'yes' END AS content"""

PAPER_COLUMNS = """doc_id,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('10.1/', CAST(doc_id % 97 AS VARCHAR(20))) END AS doi,
  concat('t ', CAST(doc_id % 131 AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN ' on the matter' ELSE '' END) AS title,
  text AS abstract, lang AS language, source,
  2000 + doc_id % 25 AS publication_year, (doc_id * 37) % 2000 AS cited_by_count"""

# Judge answers as text: plain, fenced, with a stray escape, or cut off.
RAW_COLUMNS = """conv_id, turn, claim_idx, claim_id, h, m, model_name, authority, reference_grounding, hallucination,
  CASE WHEN h % 10 = 2 THEN concat('```', chr(10), b, chr(10), '```') WHEN h % 2 = 0 THEN concat('Here: ```json', chr(10), b, chr(10), '``` done') ELSE concat(' ', b) END AS response"""
RAW_BODY = """CASE WHEN h % 31 = 5 THEN substr(f, 1, 40) ELSE f END AS b"""
RAW_FULL = """concat('{"reference_name": "ref ', CAST(m % 7 AS VARCHAR(20)), '", "reference_grounding": "', reference_grounding,
  '", "hallucination": "', hallucination, '", "hallucinated_import_detected": ', CASE WHEN m % 4 = 0 THEN 'true' ELSE 'false' END,
  ', "reason": "seen ', CASE WHEN h % 14 = 3 THEN concat(chr(92), '(t', chr(92), ')') ELSE 'x' END, '"}') AS f"""

ORACLE_VIEWS = {
    "claims_fx": """SELECT conv_id, turn, claim_idx, claim_text, conv_id * 31 + turn * 7 + claim_idx * 13 AS h,
       md5(concat_ws(':', conv_id, turn, claim_idx)) AS claim_id
FROM (SELECT conv_id, turn, CAST(u.ord - 1 AS BIGINT) AS claim_idx, trim(u.c) AS claim_text
      FROM conversations, LATERAL (SELECT unnest(a) AS c, generate_subscripts(a, 1) AS ord
           FROM (SELECT regexp_split_to_array(text, '[.] |\\n') AS a)) u
      WHERE role = 'assistant') s
WHERE length(claim_text) >= 20""",
    "judgments_fx": f"SELECT {JUDGMENT_COLUMNS} FROM (SELECT *, h + 1 AS m FROM claims_fx) t",
    "judgments2_fx": f"""SELECT {JUDGMENT_COLUMNS}
FROM (SELECT *, h + 1 + CASE WHEN h % 6 = 0 THEN 8 ELSE 0 END AS m FROM claims_fx) t""",
    "payload_fx": f"SELECT {PAYLOAD_COLUMNS} FROM claims_fx",
    "meta_fx": f"SELECT {META_COLUMNS} FROM (SELECT DISTINCT conv_id FROM conversations) c",
    "annotator1_fx": f"SELECT {ANNOTATION_COLUMNS.format(a=2, b=1)} FROM claims_fx",
    "annotator2_fx": f"SELECT {ANNOTATION_COLUMNS.format(a=3, b=2)} FROM claims_fx WHERE h % 13 <> 0",
    "papers_fx": f"SELECT {PAPER_COLUMNS} FROM documents",
    "raw_fx": f"""SELECT {RAW_COLUMNS} FROM (SELECT *, {RAW_BODY} FROM (SELECT *, {RAW_FULL}
  FROM (SELECT *, concat('m', CAST(conv_id % 5 AS VARCHAR(20))) AS model_name, concat('body ', CAST(h % 13 AS VARCHAR(20))) AS authority FROM judgments_fx) x) y) z""",
    # Turn verdicts: up to three hallucinated items of each kind, by the turn's key.
    "verdicts_fx": """SELECT conv_id, turn, q, a + b + c > 0 AND q % 6 <> 0 AS has_hallucination,
  list_transform(range(1, a + 1), lambda x: concat('pkg', CAST(q % 7 + x AS VARCHAR))) AS imports,
  list_transform(range(1, b + 1), lambda x: concat('pkg', CAST(q % 5 + x AS VARCHAR))) AS installs,
  list_transform(range(1, c + 1), lambda x: concat('pkg', CAST(q % 3 + x AS VARCHAR))) AS functions
FROM (SELECT *, q % 4 AS a, q % 3 AS b, CASE WHEN q % 5 = 0 THEN 2 ELSE 0 END AS c
      FROM (SELECT conv_id, turn, conv_id * 31 + turn * 7 AS q FROM conversations WHERE role = 'assistant') t) u""",
    # Resume state: which claims an interrupted run had cached and judged.
    "cache_fx": "SELECT * FROM claims_fx WHERE conv_id % 3 <> 0",
    "judged_fx": """SELECT * FROM judgments_fx
WHERE conv_id % 3 = 1 OR (conv_id % 3 = 2 AND claim_idx < 2)""",
    # Search hits of a claim: three organic results per step, positions 1..3.
    "hits_fx": """SELECT claim_id, h, CAST(s.step AS BIGINT) AS step, CAST(p.item AS BIGINT) AS item,
  CASE WHEN (h + s.step * 3 + p.item) % 5 = 0 THEN concat('https://ex.org/pdf/', CAST((h + s.step + p.item) % 41 AS VARCHAR(20)))
       ELSE concat('https://ex.org/', CAST((h * s.step + p.item) % 43 AS VARCHAR(20))) END AS link,
  concat('title ', CAST((h + p.item) % 19 AS VARCHAR(20))) AS title,
  CASE WHEN (h + s.step + p.item) % 7 = 0 THEN '' ELSE concat('snippet ', CAST((h + s.step * 5 + p.item) % 23 AS VARCHAR(20))) END AS snippet,
  p.item + (h % 3) AS position
FROM claims_fx, LATERAL (SELECT unnest([1, 2]) AS step) s, LATERAL (SELECT unnest([1, 2, 3]) AS item) p""",
}
NEEDS = {
    "judgments_fx": ["claims_fx"], "judgments2_fx": ["claims_fx"], "payload_fx": ["claims_fx"],
    "annotator1_fx": ["claims_fx"], "annotator2_fx": ["claims_fx"], "cache_fx": ["claims_fx"],
    "judged_fx": ["judgments_fx"], "raw_fx": ["judgments_fx"], "hits_fx": ["claims_fx"],
}


def with_views(names: str, tail: str) -> str:
    """Oracle text: the named views (and what they need) as WITH entries, then `tail`.

    `tail` starts with SELECT, or with a comma and further WITH entries.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in ordered)
    return f"WITH {views}\n{tail.strip()}"


class Inputs:
    """The given tables and the derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = apply_settings(spark), folder
        self._made: dict[object, DataFrame] = {}

    def _once(self, key: object, make) -> DataFrame:
        """Plans (not data) made once per query."""
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def claims(self, conversations: DataFrame | None = None) -> DataFrame:
        if conversations is not None:
            return self._claims(conversations)
        return self._once("claims_fx", lambda: self._claims(None))

    def _claims(self, conversations: DataFrame | None) -> DataFrame:
        turns = self.table("conversations") if conversations is None else conversations
        parts = (
            turns.filter("role = 'assistant'")
            .select("conv_id", "turn", F.posexplode(F.split("text", r"[.] |\n")).alias("claim_idx", "c"))
            .select("conv_id", "turn", F.col("claim_idx").cast("bigint"), F.trim("c").alias("claim_text"))
            .filter(F.length("claim_text") >= 20)
        )
        return parts.selectExpr(
            "conv_id", "turn", "claim_idx", "claim_text", "conv_id * 31 + turn * 7 + claim_idx * 13 AS h",
            "md5(concat_ws(':', conv_id, turn, claim_idx)) AS claim_id",
        )

    def _over(self, columns: str, source: DataFrame) -> DataFrame:
        escaped = columns.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(f"SELECT {escaped} FROM {{source}}", source=source)

    def judgments(self, second: bool = False, conversations: DataFrame | None = None) -> DataFrame:
        if conversations is not None:
            return self._judgments(second, conversations)
        return self._once(("judgments", second), lambda: self._judgments(second, None))

    def _judgments(self, second: bool, conversations: DataFrame | None) -> DataFrame:
        shift = "h + 1 + CASE WHEN h % 6 = 0 THEN 8 ELSE 0 END" if second else "h + 1"
        return self._over(JUDGMENT_COLUMNS, self.claims(conversations).withColumn("m", F.expr(shift)))

    def payload(self) -> DataFrame:
        return self._over(PAYLOAD_COLUMNS, self.claims())

    def meta(self) -> DataFrame:
        return self._over(META_COLUMNS, self.table("conversations").select("conv_id").distinct())

    def annotator(self, number: int) -> DataFrame:
        a, b = (2, 1) if number == 1 else (3, 2)
        labelled = self._over(ANNOTATION_COLUMNS.format(a=a, b=b), self.claims())
        return labelled if number == 1 else labelled.filter("h % 13 <> 0")

    def papers(self) -> DataFrame:
        return self._over(PAPER_COLUMNS, self.table("documents"))

    def raw_responses(self) -> DataFrame:
        named = self.judgments().selectExpr(
            "*", "concat('m', CAST(conv_id % 5 AS STRING)) AS model_name",
            "concat('body ', CAST(h % 13 AS STRING)) AS authority")
        return self._over(RAW_COLUMNS, self._over("*, " + RAW_BODY, self._over("*, " + RAW_FULL, named)))

    def verdicts(self) -> DataFrame:
        turns = self.table("conversations").filter("role = 'assistant'").selectExpr(
            "conv_id", "turn", "conv_id * 31 + turn * 7 AS q")

        def items(n: str, shift: int, function: str) -> str:
            return (f"transform(filter(array(1, 2, 3), x -> x <= {n}), x -> named_struct("
                    f"'package', concat('pkg', CAST(q % {shift} + x AS STRING)), 'function', {function}, "
                    "'code', concat('code ', CAST(x AS STRING)), 'reason', 'not found'))")

        return turns.selectExpr(
            "conv_id", "turn", "q", "q % 4 + q % 3 + IF(q % 5 = 0, 2, 0) > 0 AND q % 6 <> 0 AS has_hallucination",
            items("q % 4", 7, "CAST(NULL AS STRING)") + " AS hallucinated_imports",
            items("q % 3", 5, "CAST(NULL AS STRING)") + " AS hallucinated_installs",
            items("IF(q % 5 = 0, 2, 0)", 3, "concat('fn', CAST(x AS STRING))") + " AS hallucinated_function_calls",
            "'checked' AS reasoning",
        )

    def cache(self) -> DataFrame:
        return self.claims().filter("conv_id % 3 <> 0")

    def judged(self) -> DataFrame:
        return self.judgments().filter("conv_id % 3 = 1 OR (conv_id % 3 = 2 AND claim_idx < 2)")

    def hits(self) -> DataFrame:
        steps = F.explode(F.array([F.lit(i).cast("bigint") for i in (1, 2)]))
        items = F.explode(F.array([F.lit(i).cast("bigint") for i in (1, 2, 3)]))
        grid = self.claims().select("claim_id", "h", steps.alias("step")).withColumn("item", items)
        return grid.selectExpr(
            "claim_id", "h", "step", "item",
            """CASE WHEN (h + step * 3 + item) % 5 = 0 THEN concat('https://ex.org/pdf/', CAST((h + step + item) % 41 AS STRING))
               ELSE concat('https://ex.org/', CAST((h * step + item) % 43 AS STRING)) END AS link""",
            "concat('title ', CAST((h + item) % 19 AS STRING)) AS title",
            """CASE WHEN (h + step + item) % 7 = 0 THEN ''
               ELSE concat('snippet ', CAST((h + step * 5 + item) % 23 AS STRING)) END AS snippet""",
            "item + (h % 3) AS position",
        )


def turn_answers(i: Inputs) -> DataFrame:
    """(conv_id, turn, response): raw direct verdicts, fenced, flat, inside other text, or none at all."""
    v = i.verdicts()
    full = F.to_json(F.struct("has_hallucination", "hallucinated_imports", "hallucinated_installs",
                              "hallucinated_function_calls", "reasoning"))
    flat = F.to_json(F.struct("has_hallucination", "reasoning"))
    response = (
        F.when(F.col("q") % 4 == 0, F.concat(F.lit("Result:\n```json\n"), full, F.lit("\n```\nEnd.")))
        .when(F.col("q") % 4 == 1, F.concat(F.lit("I think "), flat, F.lit(" is right {maybe}")))
        .when(F.col("q") % 4 == 2, F.concat(F.lit("So: "), full, F.lit(" done")))
        .otherwise(F.concat(F.lit(" no verdict {"), F.col("q").cast("string"))))
    return v.select("conv_id", "turn", response.alias("response"))
