"""Pages, links and search hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.functions import html as H
from verdictlake.functions import urls as U
from verdictlake.functions.labels import BLANKS, text
from verdictlake.operators.turns import MIN_PAGE_CHARS
from verdictlake.scale import evaluate_once, first_n_by

# How much is fetched for one claim.
MAX_URLS = 2
MAX_PDFS = 1


def canonical_urls(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """Pages grouped by canonical URL: how many, and the first of them."""
    return pages.groupBy(U.canonical_url(url).alias("canonical_url")).agg(
        F.count("*").alias("n_pages"), F.min(key).alias(f"first_{key}"))


def extract_urls(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Web URLs found in text, one row each in order, with domain and last path part."""
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(column, F.lit(U.URL_PATTERN), 0)).alias("pos", "url"))
    kept = found.filter(U.is_web_url("url"))
    return kept.select(
        *keys, F.col("pos").cast("bigint").alias("pos"), "url",
        U.domain_name(F.col("url")).alias("domain"), U.last_segment(F.col("url")).alias("identifier"))


@F.pandas_udf(T.StructType().add("base", T.StringType()).add("hrefs", T.ArrayType(T.StringType())))
def _links(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([H.links(p or "") for p in pages], columns=["base", "hrefs"])


@F.pandas_udf(T.StringType())
def _text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: H.text(p or ""))


def extract_links(
    pages: DataFrame, predicate: Callable[[Column], Column] = U.is_pdf_href,
    key: str = "page_id", html: str = "html", url: str | None = "url",
) -> DataFrame:
    """Distinct anchors of each page that satisfy the predicate, resolved against the page, by first place.

    Links stand as a browser sees them: not in comments or scripts, in any order and quoting of
    attributes, references decoded, relative to `<base href>` where a page has one. Pages are
    grouped by their key and link, never gathered: a page with many links stays spread out.
    """
    found = evaluate_once(pages.select(key, *([url] if url else []), html), "_found", _links(F.col(html)))
    anchors = found.select(
        key, *([F.col(url).alias("_url")] if url else []), F.col("_found.base").alias("_base"),
        F.posexplode("_found.hrefs").alias("pos", "href")).filter(predicate(F.col("href")))
    link = F.col("href")
    if url:
        base = F.when(F.col("_base").isNull(), F.col("_url")).otherwise(U.resolve(F.col("_base"), F.col("_url")))
        link = U.resolve(F.col("href"), F.col("_at"))
        anchors = evaluate_once(anchors, "_at", base)
    named = evaluate_once(anchors, "link", link)
    ok = U.scheme(F.col("link")).isin("http", "https", "") | F.col("link").startswith("/")
    return named.filter(ok).groupBy(key, "link").agg(F.min("pos").cast("bigint").alias("pos"))


def page_text(
    pages: DataFrame, max_words: int | None = None, min_chars: int = MIN_PAGE_CHARS, html: str = "html"
) -> DataFrame:
    """Main text of pages: furniture and markup removed, entities decoded, long texts cut with a mark.

    Extraction is defined by the contract of `functions.html`: head, script, style, nav, header,
    footer, aside, noscript and template go with all that is nested in them, so do comments and
    elements of the class `ad` or `ads`; blocks and `<br>` stand on lines of their own.
    """
    out = evaluate_once(pages, "content", _text(F.col(html)))
    if max_words is not None:
        words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
        out = evaluate_once(out, "_words", words)
        mark = F.lit(f"\n\n[Content truncated at {max_words} words]")
        cut = F.concat(F.array_join(F.slice("_words", 1, max_words), " "), mark)
        out = out.withColumn("content", F.when(F.size("_words") > max_words, cut).otherwise(F.col("content"))
                             ).drop("_words")
    return out.filter(F.length(F.btrim("content", F.lit(BLANKS))) >= min_chars)


# ---- search hits ---------------------------------------------------------------------------


def flatten_search_hits(df: DataFrame) -> DataFrame:
    """Answer box, knowledge graph and organic hits of each result set as content rows, in order.

    Needs claim_id, step, organic, answer_box and knowledge_graph.
    """
    answer = F.coalesce(F.nullif(F.col("answer_box.answer"), F.lit("")), F.col("answer_box.snippet"), F.lit(""))
    graph = F.col("knowledge_graph")
    attributes = F.transform(
        F.map_entries(F.coalesce(graph["attributes"], F.create_map().cast("map<string,string>"))),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    described = F.filter(F.array(text(graph["description"])), lambda x: x != "")
    body = F.array_join(F.concat(described, attributes), "\n")

    def row(kind: int, pos: Column, title: Column, url: Column, snippet: Column, content: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), title.alias("title"), url.alias("url"),
            snippet.alias("snippet"), content.alias("content"))

    zero, blank = F.lit(0), F.lit("")
    box = F.array(row(0, zero, F.lit("Answer Box"), blank, answer, answer))
    card = F.array(row(1, zero, F.coalesce(graph["title"], F.lit("Knowledge Graph")), blank, blank, body))
    organic = F.transform(
        F.coalesce("organic", F.array()),
        lambda o, i: row(2, i, text(o["title"]), text(o["link"]), text(o["snippet"]), text(o["snippet"])))
    kept = F.filter(F.concat(box, card, organic), lambda r: r["content"] != "")
    return df.select("claim_id", "step", F.explode(kept).alias("r")).select("claim_id", "step", "r.*")


def hit_lines(df: DataFrame, indexed: bool) -> DataFrame:
    """Text of each result set: ` -- ` joined, or with `[step.item]` marks a model can point to."""
    box = F.col("answer_box")
    graph = F.col("knowledge_graph")
    step = F.col("step").cast("string")
    no_map = F.create_map().cast("map<string,string>")
    if indexed:
        answer = F.coalesce(F.nullif(box["snippet"], F.lit("")), box["answer"])
        head = F.array(
            F.concat(F.lit("## Search Step "), step),
            F.concat(F.lit("[Step "), step, F.lit(" AnswerBox] "), answer))
        items = F.transform(F.coalesce("organic", F.array()), lambda o, i: F.concat(
            F.lit("["), step, F.lit("."), (i + 1).cast("string"), F.lit("] Title: "),
            F.coalesce(o["title"], F.lit("No Title")), F.lit("\nLink: "), F.coalesce(o["link"], F.lit("No Link")),
            F.lit("\nSnippet: "), F.coalesce(o["snippet"], F.lit("No Snippet"))))
        return df.withColumn("rendered", F.array_join(F.concat(F.array_compact(head), items), "\n\n"))

    def filled(*cols: Column) -> Column:
        return F.filter(F.array(*[text(c) for c in cols]), lambda x: x != "")

    def told(entries: Column, prefix: Column) -> Column:
        return F.transform(F.map_entries(F.coalesce(entries, no_map)),
                           lambda e: F.concat(prefix, e["key"], F.lit(": "), e["value"], F.lit(".")))

    title = text(graph["title"])
    kind = F.when(text(graph["type"]) != "", F.concat(title, F.lit(": "), graph["type"], F.lit(".")))
    hits = F.flatten(F.transform(F.coalesce("organic", F.array()), lambda o: F.concat(
        filled(o["title"], o["date"], o["link"], o["snippet"]), told(o["attributes"], F.lit("")))))
    parts = F.concat(
        F.transform(filled(box["answer"], box["snippet"]), lambda x: F.replace(x, F.lit("\n"), F.lit(" "))),
        filled(kind, graph["description"]), told(graph["attributes"], F.concat(title, F.lit(" "))), hits)
    return df.withColumn("rendered", F.when(F.size(parts) > 0, F.array_join(parts, " -- ")).otherwise("No results"))


def render_hits(df: DataFrame, indexed: bool = False) -> DataFrame:
    """Search text of each claim: its result sets (a few steps) in order, blank line between."""
    return hit_lines(df, indexed).groupBy("claim_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "rendered"))),
                                 lambda s: s["rendered"]), "\n\n").alias("search_text"))


REF = r"^\[?(\d+)\.(\d+)\]?"


def claim_layout(hits: DataFrame, refs: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """One row per claim: its hits by (step, item), its references by place, its claimed URL.

    The three tables meet in one shuffle on the claim. A claim's rows are a few steps of some
    ten results and a planner's list, so they are held together; plans, references and
    descriptions are then array functions of the row.
    """
    hit = F.struct("step", "item", text("link").alias("link"), *[(text(c) if c in hits.columns else F.lit("")).alias(c) for c in ("title", "snippet")],
                   (F.coalesce("position", F.lit(999)) if "position" in hits.columns else F.lit(999)).cast("bigint").alias("position"))
    parts = [hits.select("claim_id", hit.alias("_hit"))]
    if refs is not None:
        parts.append(refs.select("claim_id", F.struct(F.col("pos").cast("bigint").alias("pos"), F.btrim("ref", F.lit(BLANKS)).alias("ref")).alias("_ref")))
    if claims is not None:
        parts.append(claims.select("claim_id", F.btrim(text("claimed_url"), F.lit(BLANKS)).alias("_url")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)

    def gathered(column: str, empty: str):
        return F.sort_array(F.collect_list(column)) if column in rows.columns else F.array().cast(empty)

    return rows.groupBy("claim_id").agg(
        gathered("_hit", "array<string>").alias("hits"), gathered("_ref", "array<struct<pos: bigint, ref: string>>").alias("refs"),
        (F.max("_url") if "_url" in rows.columns else F.lit(None).cast("string")).alias("claimed_url"))


def _resolved(refs: Column, hits: Column) -> Column:
    """(pos, url) of the references that name a hit, are a known link or start with http."""
    def url(r: Column) -> Column:
        step, item = (F.regexp_extract(r["ref"], REF, k).try_cast("bigint") for k in (1, 2))
        at = F.get(F.filter(hits, lambda h: (h["step"] == step) & (h["item"] == item) & (h["link"] != "")), F.lit(0))["link"]
        known = F.exists(hits, lambda h: (h["link"] != "") & (h["link"] == r["ref"]))
        return F.struct(r["pos"].alias("pos"), F.coalesce(at, F.when(known | r["ref"].startswith("http"), r["ref"])).alias("url"))

    return F.filter(F.transform(refs, url), lambda p: p["url"].isNotNull())


def resolve_refs(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """`[step.item]` references to links; known links and anything starting with http stay, the rest goes.

    `refs` carries claim_id, pos, ref.
    """
    layout = claim_layout(hits, refs)
    found = layout.select("claim_id", F.explode(_resolved(F.col("refs"), F.col("hits"))).alias("p"))
    return found.select("claim_id", F.col("p.pos").cast(dict(refs.dtypes)["pos"]).alias("pos"), "p.url")


def fetch_plan(layout: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """Pages to fetch per claim of a `claim_layout`: the claimed URL, then the planner's picks, then organic hits by position; no PDFs.

    With each URL its tier, and title and snippet of the last hit that links it (blank if none does).
    """
    hits, zero = F.col("hits"), F.lit(0).cast("bigint")

    def row(tier: int, url: Column, a: Column, b: Column, c: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c"), url.alias("url"))

    direct = F.filter(F.array(row(1, F.col("claimed_url"), zero, zero, zero)), lambda r: U.is_web_url(r["url"]))
    picked = F.transform(_resolved(F.col("refs"), hits), lambda p: row(2, p["url"], p["pos"], zero, zero))
    organic = F.transform(F.filter(hits, lambda h: h["link"] != ""), lambda h: row(3, h["link"], h["position"], h["step"], h["item"]))
    every = F.sort_array(F.filter(F.concat(direct, picked, organic), lambda r: ~U.is_pdf_url_simple(r["url"])))
    urls = F.transform("_every", lambda r: r["url"])
    first = F.filter("_every", lambda r, k: F.array_position(urls, r["url"]) == k + 1)
    held = evaluate_once(layout, "_every", every)
    planned = held.select("claim_id", "hits", F.explode(F.slice(first, 1, max_urls)).alias("r"))
    last = F.get(F.reverse(F.filter(hits, lambda h: h["link"] == F.col("r.url"))), F.lit(0))
    return planned.select("claim_id", "r.url", F.col("r.tier").cast("bigint").alias("tier"),
                          F.coalesce(last["title"], F.lit("")).alias("title"), F.coalesce(last["snippet"], F.lit("")).alias("snippet"))


def pdf_plan(claims: DataFrame, hits: DataFrame, page_links: DataFrame, max_pdfs: int = MAX_PDFS) -> DataFrame:
    """PDFs to fetch per claim: the claimed one, then those among the hits, then those linked on pages.

    `page_links` carries claim_id, pos, url.
    """
    zero = F.lit(0).cast("bigint")
    stripped = F.btrim(text("claimed_url"), F.lit(BLANKS))
    direct = claims.filter(U.is_web_url(stripped) & U.is_pdf_url_simple(stripped)).select(
        "claim_id", stripped.alias("url"), F.lit(1).alias("tier"), zero.alias("a"), zero.alias("b"), zero.alias("c"))
    found = hits.filter(U.is_pdf_url_simple("link")).select(
        "claim_id", F.col("link").alias("url"), F.lit(2).alias("tier"), F.col("step").alias("a"), F.col("item").alias("b"), zero.alias("c"))
    linked = page_links.select(
        "claim_id", "url", F.lit(3).alias("tier"), F.col("pos").cast("bigint").alias("a"), zero.alias("b"), zero.alias("c"))
    return _first_urls(direct.unionByName(found).unionByName(linked), max_pdfs)


def _first_urls(every: DataFrame, n: int) -> DataFrame:
    """Distinct URLs per claim by their best place, the first n of them, with their rank."""
    best = every.groupBy("claim_id", "url").agg(F.min(F.struct("tier", "a", "b", "c")).alias("at"))
    kept = first_n_by(best, ["claim_id"], ["at", "url"], n)
    return kept.select("claim_id", "url", F.col("at.tier").cast("bigint").alias("tier"))


def distinct_ordered(df: DataFrame, keys: Sequence[str], value: str, order: str, keep: str = "first") -> DataFrame:
    """Each value of a key once, with its first (or last) position."""
    pick = F.min if keep == "first" else F.max
    return df.groupBy(*keys, value).agg(pick(order).alias(order))
