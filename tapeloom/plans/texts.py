"""Queries of the text rules. Headlines are made of names and phrases, so that the rules have something to find."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import text as tx
from tapeloom.functions import vocabulary as v

from .base import query, table

PHRASES = [
    "bags large order worth Rs 500 crore", "profit jumps on strong exports", "shares plunge after downgrade", "receives show cause notice from tax office", "board meeting to consider and approve results", "announces capacity expansion at new plant", "top gainers and losers today", "approval of merger with unit",
    "record date for dividend", "raises funds through QIP", "rating upgraded by agency", "defaults on loan, insolvency plea", "wins railway capex contract from state", "10 small cap stocks to watch", "green hydrogen and renewable energy push", "fell, posts loss as revenue falls", "quiet day", "bonus issue and buyback", "resignation of CFO", "trading window closure",
]
NAMES = ["Acme Industries Limited", "Nova Tech Ltd.", "Blue River Ltd", "The India Company", "Orbit Systems", "Zen", "Lotus & Sons Limited"]


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


HEAD = f"WITH h AS (SELECT c_custkey AS id, {lst(NAMES)}[c_custkey % {len(NAMES)} + 1] AS name, CASE WHEN c_custkey % 3 = 0 THEN {lst(PHRASES)}[c_custkey % {len(PHRASES)} + 1] ELSE {lst(NAMES)}[c_custkey % {len(NAMES)} + 1] || ' ' || {lst(PHRASES)}[c_custkey % {len(PHRASES)} + 1] END AS title, {lst(v.TRUSTED[:3] + ['a blog', 'Unknown Wire'])}[c_custkey % 5 + 1] AS source, DATE '2024-06-30' - (c_custkey % 90)::int AS date FROM customer)"


def pick(words, key):
    return F.get(F.array(*[F.lit(w) for w in words]), (key % len(words)).cast("int"))


def headlines(spark, sf):
    k = F.col("c_custkey")
    name, phrase = pick(NAMES, k), pick(PHRASES, k)
    title = F.when(k % 3 == 0, phrase).otherwise(F.concat(name, F.lit(" "), phrase))
    return table(spark, sf, "customer").select(k.alias("id"), name.alias("name"), title.alias("title"), pick(v.TRUSTED[:3] + ["a blog", "Unknown Wire"], k).alias("source"), F.date_sub(F.lit("2024-06-30").cast("date"), (k % 90).cast("int")).alias("date"))


def rx(column: str, patterns) -> str:
    return f"regexp_matches({column}, '{tx.any_of([p.split('(?!')[0] for p in patterns])}')".replace("''", "'")


def hits(words) -> str:
    return "(" + "+".join(f"regexp_matches(lower(title), '{tx.word_pattern(w)}')::int" for w in words) + ")"


ROUND = rx("lower(title)", v.ROUNDUP)
TOKENS = f"list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({lst(v.GENERIC)}, w))"


@query(f"{HEAD} SELECT DISTINCT name, rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), ' limited$', ''), ' ltd\\.$', ''), ' ltd$', ''), ' .'), ' .') AS company, array_to_string(CASE WHEN len({TOKENS}) > 0 THEN {TOKENS} ELSE regexp_extract_all(lower(name), '[a-z0-9]+') END, ' ') AS tokens FROM h")
def name_tokens(spark, sf):
    h = headlines(spark, sf).select("name").distinct()
    return h.select("name", tx.normalize_company(F.col("name")).alias("company"), F.array_join(tx.name_tokens(F.col("name")), " ").alias("tokens"))


@query(f"{HEAD}, t AS (SELECT *, CASE WHEN len({TOKENS}) > 0 THEN {TOKENS} ELSE regexp_extract_all(lower(name), '[a-z0-9]+') END AS tk FROM h) SELECT id, contains(lower(title), lower(trim(name))) OR (len(list_filter(tk, lambda w: regexp_matches(lower(title), '\\b' || w))) >= least(len(tk), 2) AND len(tk) > 0) AS relevant FROM t")
def headline_relevance(spark, sf):
    return headlines(spark, sf).select("id", tx.is_relevant(F.col("title"), F.col("name")).alias("relevant"))


@query(f"{HEAD} SELECT id, len(list_filter({lst(v.TRUSTED)}, lambda s: contains(lower(source), s))) > 0 AS trusted, {ROUND} AS roundup, CASE WHEN {ROUND} THEN 0 ELSE sign({hits(v.UP)} - {hits(v.DOWN)})::int END AS sentiment FROM h")
def headline_quality(spark, sf):
    t = F.col("title")
    return headlines(spark, sf).select("id", tx.is_trusted(F.col("source")).alias("trusted"), tx.is_roundup(t).alias("roundup"), tx.sentiment(t).alias("sentiment"))


@query(f"{HEAD} SELECT id, array_to_string(list_filter({lst(v.THEMES)}, lambda s: contains(lower(title), lower(s))), ',') AS themes, array_to_string(list_filter({lst(v.EVENTS)}, lambda s: contains(lower(title), lower(s))), ',') AS events FROM h")
def theme_tags(spark, sf):
    t = F.col("title")
    return headlines(spark, sf).select("id", F.array_join(tx.keyword_hits(t, v.THEMES), ",").alias("themes"), F.array_join(tx.keyword_hits(t, v.EVENTS), ",").alias("events"))


LADDER = " ".join(f"WHEN {rx('lower(title)', p)} THEN '{a}: {e}'" for a, e, p in v.LADDER)
KIND = f"CASE WHEN {rx('lower(title)', v.NOISE)} THEN NULL WHEN {rx('lower(title)', [v.MERGER_APPROVAL])} THEN 'pos: M&A/JV' {LADDER} END"


@query(f"{HEAD} SELECT id, {KIND} AS kind FROM h")
def filing_classify(spark, sf):
    return headlines(spark, sf).select("id", tx.classify(F.col("title")).alias("k")).select("id", F.when(F.col("k").isNotNull(), F.concat("k.polarity", F.lit(": "), "k.event")).alias("kind"))


@query(f"{HEAD}, k AS (SELECT name, date, title, {KIND} AS kind FROM h WHERE date > DATE '2024-05-15') SELECT name, kind, count(*) AS n, max(date) AS latest, arg_max(title, (date, title)) AS newest FROM k WHERE kind IS NOT NULL GROUP BY 1, 2")
def filings_radar(spark, sf):
    k = headlines(spark, sf).filter("date > DATE'2024-05-15'").withColumn("k", tx.classify(F.col("title"))).filter("k is not null")
    return k.groupBy("name", F.concat("k.polarity", F.lit(": "), "k.event").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest"), F.max_by("title", F.struct("date", "title")).alias("newest"))


@query(f"""{HEAD}, x AS (SELECT name, date, list_filter({lst(v.THEMES)}, lambda s: contains(lower(title), lower(s))) AS th FROM h), u AS (SELECT name, count(*) AS items, max(CASE WHEN len(th) > 0 THEN date END) AS latest FROM x GROUP BY 1),
 d AS (SELECT name, count(DISTINCT t) AS themes FROM (SELECT name, unnest(th) AS t FROM x) GROUP BY 1) SELECT name, items, coalesce(themes, 0) AS themes, round(CASE WHEN coalesce(themes, 0) > 0 THEN 0.5*least(themes/3.0, 1.0)+0.3*greatest(1-date_diff('day', latest, DATE '2024-06-30')/60.0, 0.0)+0.2*least(items/10.0, 1.0) ELSE 0 END::double, 6) AS score FROM u LEFT JOIN d USING (name)""")
def catalyst_score(spark, sf):
    x = headlines(spark, sf).withColumn("th", tx.keyword_hits(F.col("title"), v.THEMES))
    u = x.groupBy("name").agg(F.count(F.lit(1)).alias("items"), F.max(F.when(F.size("th") > 0, F.col("date"))).alias("latest"), F.size(F.array_distinct(F.flatten(F.collect_set("th")))).cast("long").alias("themes"))
    days = F.date_diff(F.lit("2024-06-30").cast("date"), "latest")
    return u.select("name", "items", "themes", F.round(tx.catalyst(F.col("themes"), F.col("items"), days), 6).alias("score"))


@query("""WITH f AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 60)::varchar AS company FROM supplier), u AS (SELECT DISTINCT p_brand AS symbol FROM part), e AS (SELECT s_suppkey, company, symbol, CASE WHEN company = symbol THEN 0 ELSE 1 END AS g
 FROM f JOIN u ON company = symbol OR (length(company) >= 6 AND length(symbol) >= 6 AND (starts_with(company, symbol) OR starts_with(symbol, company)))) SELECT s_suppkey, company, arg_min(symbol, (g, symbol)) AS symbol FROM e GROUP BY 1, 2""")
def prefix_match(spark, sf):
    """Company to symbol: equal, else one begins with the other, by their first six characters as the join's key."""
    f = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("company"))
    u = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    # Both sides have six characters at least, so that matches share their first six: an equi-join, not a nested loop.
    six = f.filter(F.length("company") >= 6).withColumn("k", F.substring("company", 1, 6)).join(u.filter(F.length("symbol") >= 6).withColumn("k", F.substring("symbol", 1, 6)), "k")
    both = six.filter(F.expr("startswith(company, symbol) or startswith(symbol, company)"))
    best = F.min_by("symbol", F.struct((F.col("company") != F.col("symbol")).cast("int").alias("g"), "symbol"))
    return both.groupBy("s_suppkey", "company").agg(best.alias("symbol"))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS n_chars, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages")
def html_strip_tags(spark, sf):
    t = tx.strip_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.char_length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


@query()
def html_tables(spark, sf):
    """Rows and cells of the tables of pages."""
    rows = tx.table_rows(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(rows).alias("n_rows"), F.array_join(F.flatten(rows), "|").alias("cells"))


@query("WITH a AS (SELECT doc_id, left(text, 80) AS k, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS p FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, doc_id) AS n FROM a) SELECT doc_id, p AS archived FROM n WHERE n = 1")
def filings_union_dedupe(spark, sf):
    """Live filings and archived ones, once for each beginning of 80 characters, live first."""
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 80).alias("k"))
    both = d.filter("doc_id % 3 = 0").withColumn("archived", F.lit(0)).unionByName(d.filter("doc_id % 3 <> 0").withColumn("archived", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("k").orderBy("archived", "doc_id"))
    return both.withColumn("n", first).filter("n = 1").select("doc_id", "archived")
