"""Link rules of each source, lists in free text, merged terms, owners, batch reports and fills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..functions.lexicon import bound
from ..functions.links import WEB_LINK_SQL, web_link
from ..operators import rewrite as R
from ..operators import state as S
from ..sources import pages as P
from ..sources.tables import NEWS_SQL, news, spread, table
from .curation import CORRECTIONS, PATTERNS, PREFIXES, TERMS, _POST, _prefix_sql
from .registry import query

WITH = f"WITH {NEWS_SQL}"

RULES = [
    P.LinkRule("m", 3, r"example\\.(?:org|net)", stop_titles=("the", "for")), P.LinkRule("www", 5, "example", reject="/[A-Z]", attribute_first=True), P.LinkRule("blog", 2, r"/[a-z]+$", most=3),
]
_RULE_ROWS = ", ".join(f"('{r.source}', {r.least_title}, '{r.accept}', '{r.reject}', {list(r.stop_titles)}::VARCHAR[], {r.most})" for r in RULES)
_ANCHOR = """(?is)<a\\s[^>]*?href=["'']?([^"''>\\s]*)["'']?[^>]*>(.*?)</a>"""


@query(f"""WITH r(source, least_title, accept, reject, stops, most) AS (VALUES {_RULE_ROWS.replace("(?!)", "^$")}), p AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([a-z]+)\\.', 1) AS source FROM pages),
    a AS (SELECT source, page_id, url, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '{_ANCHOR}', 2)), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title,
        generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 1), 1) AS place FROM p),
    b AS (SELECT *, {WEB_LINK_SQL} AS link FROM (SELECT *, url AS base FROM a JOIN r USING (source) WHERE href <> '')),
    c AS (SELECT *, row_number() OVER (PARTITION BY source, link ORDER BY page_id, place) AS n FROM b WHERE length(title) >= least_title AND NOT list_contains(stops, title) AND regexp_matches(link, accept) AND NOT regexp_matches(link, reject)),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rank FROM c WHERE n = 1)
    SELECT source, page_id, rank, link, title, NULL::DATE AS day FROM d WHERE rank <= most""")
def page_links_by_rule(spark, sf_dir):
    """Links by the rule of each page's source; these pages' links hold no dates."""
    pages = spread(table(spark, sf_dir, "pages")).withColumn("source", F.regexp_extract("url", r"^[a-z]+://([a-z]+)\.", 1))
    return P.rule_links(pages, P.rule_table(spark, RULES))


#: References as pages write them: by what they stand for in RFC 3986, the word of a link in each.
_FORMS = (
    "/{}", "{}", "../{}", "./{}/../x.html", "?q={}", "#{}", "//cdn.example/{}", "HTTP://Other.example/{}", "https://other.example/a/./{}", "javascript:go('{}')", "mailto:{}@a.example",
    "../../../../{}/..", "{}//y/", "/a/../{}?r=../z#s", " {}", "/p?x=1&amp;y={}", ".", "..", "", "{}.pdf", "/files/{}.PDF",
)
_FORMS_SQL = ", ".join("'" + f.replace("'", "''") + "'" for f in _FORMS)
_WORDS_SQL = f"""SELECT page_id, url AS base, place, replace(([{_FORMS_SQL}])[(page_id + place) % {len(_FORMS)} + 1], '{{}}', word) AS href FROM (
    SELECT page_id, url, ltrim(unnest(hrefs), '/') AS word, generate_subscripts(hrefs, 1) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages))"""


def _references(spark, sf_dir):
    """(page_id, url, place, href): the links of all pages, each written in another of these forms."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    words = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("place", "word")).withColumn("place", (F.col("place") + 1).cast("bigint"))
    form = F.element_at(F.array(*map(F.lit, _FORMS)), ((F.col("page_id") + F.col("place")) % len(_FORMS) + 1).cast("int"))
    return words.select("page_id", "url", "place", F.replace(form, F.lit("{}"), F.ltrim("word", F.lit("/"))).alias("href"))


@query(f"""WITH w AS ({_WORDS_SQL}) SELECT page_id, place, href, {WEB_LINK_SQL} AS link FROM w""")
def resolved_links(spark, sf_dir):
    """Relative, rooted, dotted, query-only and other references against their pages; what isn't a web page is null."""
    return _references(spark, sf_dir).select("page_id", "place", "href", web_link(F.col("href"), F.col("url")).alias("link"))


def _with_references(spark, sf_dir):
    """Pages of these references alone."""
    one = F.concat(F.lit('<a class="x" href="'), F.col("href"), F.lit('">link '), F.col("place").cast("string"), F.lit("</a>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", one.alias("a")))), lambda x: x["a"]), "\n")
    return _references(spark, sf_dir).groupBy("page_id", "url").agg(body.alias("html"))


@query(f"""WITH w AS ({_WORDS_SQL}) SELECT DISTINCT page_id, link FROM (SELECT page_id, {WEB_LINK_SQL} AS link FROM w WHERE regexp_matches(href, '(?i)[.]pdf$'))""")
def pdf_files(spark, sf_dir):
    """The distinct PDF files that pages link to."""
    return P.pdf_links(_with_references(spark, sf_dir))


_DATED = [
    P.LinkRule("en", 4, r"/\d{4}/\d{4}/\d+\.shtml", date=r"/(\d{4})/(\d{2})(\d{2})/", most=7), P.LinkRule("de", 4, r"/\d{6}/t\d{8}_\d+\.html", date=r"/\d{6}/t(\d{4})(\d{2})(\d{2})_", most=5),
    P.LinkRule("fr", 4, r"\.html$", date=r"/(\d{4})-(\d{2})/(\d{2})/"),
]
_DATED_ROWS = ", ".join(f"('{r.source}', '{r.accept}', '{r.date}', {r.most})" for r in _DATED)
#: A day of the year from page and place (February has a 30th then, which is none), and a link of each source's kind. Two list pages share each third link.
_DATED_SQL = """SELECT source, page_id, place, title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/list/' AS base,
    CASE source WHEN 'en' THEN '../' || y || '/' || m || d || '/' || k || '.shtml' WHEN 'de' THEN './' || y || m || '/t' || y || m || d || '_' || k || '.html' ELSE '/' || y || '-' || m || '/' || d || '/' || k || '.html' END AS href
    FROM (SELECT source, page_id, url, place, title, '2024' AS y, printf('%02d', 1 + k % 13) AS m, printf('%02d', 1 + (k // 13) % 30) AS d, k::VARCHAR AS k FROM (
        SELECT regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS source, page_id, url, place, 'title ' || place AS title, CASE WHEN place % 3 = 0 THEN place ELSE page_id * 7 + place END AS k FROM (
            SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS place FROM pages)))"""


@query(f"""WITH r(source, accept, date, most) AS (VALUES {_DATED_ROWS}), a AS (SELECT *, {WEB_LINK_SQL} AS link FROM ({_DATED_SQL})),
    c AS (SELECT *, row_number() OVER (PARTITION BY source, link ORDER BY page_id, place) AS n FROM a JOIN r USING (source) WHERE regexp_matches(link, accept)),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rank FROM c WHERE n = 1)
    SELECT source, page_id, rank, link, title, try_cast(regexp_extract(link, date, 1) || '-' || regexp_extract(link, date, 2) || '-' || regexp_extract(link, date, 3) AS DATE) AS day FROM d WHERE rank <= most""")
def dated_links_of_list_pages(spark, sf_dir):
    """Links of several list pages of each source, which share some, with the day that stands in them in the source's own way."""
    places = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    own = spread(table(spark, sf_dir, "pages")).select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]+)/", 1).alias("source"), F.size(places).alias("n")).where("n > 0")

    def link(place):
        k = F.when(place % 3 == 0, place.cast("bigint")).otherwise(F.col("page_id") * 7 + place)
        m, d, k = F.lpad((1 + k % 13).cast("string"), 2, "0"), F.lpad((1 + F.floor(k / 13) % 30).cast("string"), 2, "0"), k.cast("string")
        href = F.when(F.col("source") == "en", F.concat(F.lit("../2024/"), m, d, F.lit("/"), k, F.lit(".shtml"))).when(F.col("source") == "de", F.concat(F.lit("./2024"), m, F.lit("/t2024"), m, d, F.lit("_"), k, F.lit(".html")))
        href = href.otherwise(F.concat(F.lit("/2024-"), m, F.lit("/"), d, F.lit("/"), k, F.lit(".html")))
        return F.concat(F.lit("<a href='"), href, F.lit("'>title "), place.cast("string"), F.lit("</a>"))

    html = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), link), "\n")
    pages = bound(own, "html", html).select("source", "page_id", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1), F.lit("/list/")).alias("url"), "html")
    return P.rule_links(pages, P.rule_table(spark, _DATED))


_LISTED = "translate(text, '[]{}\"\\', '')"


@query(f"""WITH t AS (SELECT conv_id, turn, {_LISTED} AS t, list_slice(string_split({_LISTED}, ' '), 1, 3) AS w FROM conversations),
    i AS (SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN w ELSE list_filter(list_transform(string_split(t || chr(10) || '- 2. one more', chr(10)), lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(13)), '^[\\d.\\-*•]+\\s*', '')), lambda x: x <> '' AND length(x) < 50) END AS items FROM t)
    SELECT conv_id, turn, len(items)::BIGINT AS n, array_to_string(items, '|') AS items FROM i""")
def listed_items(spark, sf_dir):
    """Items from answers as a JSON object, a JSON array behind a broken object, or plain lines."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate("text", '[]{}"\\', "").alias("t"))
    words = F.slice(F.split("t", " "), 1, 3)
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here: "), F.to_json(F.struct(words.alias("items"), F.lit(1).alias("n"))), F.lit(" ok"))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit('{"items": broken} '), F.to_json(words))
    ).otherwise(F.concat("t", F.lit("\n- 2. one more")))
    items = X.listed_items(said, "items", "nothing")
    return own.select("conv_id", "turn", F.size(items).cast("bigint").alias("n"), F.array_join(items, "|").alias("items"))


@query("""WITH w AS (SELECT conv_id, turn, list_slice(string_split(translate(text, '[]{}"\\`' || chr(10), ''), ' '), 1, 9) AS w FROM conversations)
    SELECT conv_id, turn, p - 1 AS place, w[p] AS name, CASE WHEN p % 2 = 0 THEN 0 ELSE len(w) END::BIGINT AS n_steps, CASE WHEN p % 2 = 1 THEN w[len(w)] || ' } "' || w[1] END AS last_step
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM w WHERE turn % 5 <> 4) ORDER BY ALL""")
def recipes_in_answers(spark, sf_dir):
    """Objects of a list in free text, with lists of their own: fenced, bare, among other braces, behind a block without them; of a cut-off answer, none."""
    words = F.slice(F.split(F.translate("text", '[]{}"\\`\n', ""), " "), 1, 9)
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    steps = F.transform("w", lambda x: F.concat(x, F.lit(' } "'), F.element_at("w", 1)))
    recipes = F.to_json(F.struct(F.transform("w", lambda x, i: F.struct(x.alias("name"), F.when(i % 2 == 0, steps).otherwise(F.array().cast("array<string>")).alias("steps"))).alias("recipes")))
    forms = (F.concat(F.lit("Sure } so:\n```json\n"), recipes, F.lit("\n```")), F.concat(F.lit("Here: "), recipes, F.lit(' and {"b": 2} }')), recipes, F.concat(F.lit('```\nno object\n``` but '), recipes), F.left(recipes, F.length(recipes) - 1))
    said = F.element_at(F.array(*forms), (F.col("turn") % 5 + 1).cast("int"))
    found = F.from_json(X.answered(said, "recipes"), "array<struct<name:string,steps:array<string>>>")
    items = own.select("conv_id", "turn", F.posexplode(found).alias("place", "r"))
    return items.select("conv_id", "turn", F.col("place").cast("bigint").alias("place"), "r.name", F.size("r.steps").cast("bigint").alias("n_steps"), F.try_element_at("r.steps", F.lit(-1)).alias("last_step"))


@query("""WITH t AS (SELECT n_nationkey AS key, n_name AS value, 1 AS turn FROM nation UNION ALL SELECT s_nationkey, s_name, 2 FROM (SELECT s_nationkey, max(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    UNION ALL SELECT r_regionkey, r_name, 3 FROM region) SELECT key::INT AS key, arg_max(value, turn) AS value FROM t GROUP BY key""")
def merged_dictionaries(spark, sf_dir):
    """Three dictionaries put over each other, a later one's terms over an earlier one's."""
    one = lambda df, k, v: df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(k).cast("int").alias("k"), F.col(v).alias("v")))).alias("m"))
    # dictionaries of nations, bounded by their number: one row each
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.max("s_name").alias("s_name"))
    first, second, third = one(table(spark, sf_dir, "nation"), "n_nationkey", "n_name"), one(suppliers, "s_nationkey", "s_name"), one(table(spark, sf_dir, "region"), "r_regionkey", "r_name")
    joined = first.toDF("a").join(second.toDF("b")).join(third.toDF("c"))
    return joined.select(F.explode(X.merged_terms(F.col("a"), F.col("b"), F.col("c"))).alias("key", "value"))


@query("""SELECT event_id, user_id FROM events e WHERE NOT (event_id % 7 = 0 AND event_id % 2 = 0)""")
def delete_with_owner_check(spark, sf_dir):
    """Requests to delete rows count only if they come from the row's owner: a composite key."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    requests = events.where("event_id % 7 = 0").select("event_id", (F.col("user_id") + F.col("event_id") % 2).alias("user_id"))
    return events.join(requests, ["event_id", "user_id"], "left_anti")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'edited' ELSE event_type END AS event_type, (event_id % 7 = 0 AND event_id % 2 = 0) AS changed FROM events""")
def update_with_owner_check(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    requests = events.where("event_id % 7 = 0").select("event_id", (F.col("user_id") + F.col("event_id") % 2).alias("_owner"))
    joined = events.join(requests, "event_id", "left").withColumn("changed", F.col("_owner").eqNullSafe(F.col("user_id")))
    return S.where_set(joined, F.col("changed"), {"event_type": F.lit("edited")}).select("event_id", "event_type", "changed")


@query(f"""{WITH}, d AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE published_at END AS published_at FROM news) SELECT id, coalesce(published_at, TIMESTAMP '2024-01-31') AS published_at, published_at IS NULL AS filled FROM d""")
def filled_dates(spark, sf_dir):
    """Items without a date get that of the run."""
    own = news(spark, sf_dir).select("id", F.when(F.col("id") % 10 != 0, F.col("published_at")).alias("published_at"))
    missing = F.col("published_at").isNull()
    return S.where_set(own.withColumn("filled", missing), F.col("filled"), {"published_at": F.expr("timestamp_ntz'2024-01-31 00:00:00'")})


@query("""SELECT conv_id, turn, md5(to_base64(encode(text))) AS coded, md5(text) AS decoded FROM conversations""")
def base64_texts(spark, sf_dir):
    coded = F.translate(F.base64(F.encode("text", "utf-8")), "\r\n", "")  # in one line
    back = F.decode(F.unbase64(coded), "utf-8")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(coded.cast("binary")).alias("coded"), F.md5(back.cast("binary")).alias("decoded"))


@query(f"""{WITH}, r AS (SELECT source, id, importance, row_number() OVER (PARTITION BY source ORDER BY importance, id) AS low, row_number() OVER (PARTITION BY source ORDER BY importance DESC, id) AS high FROM news)
    SELECT source, id, CASE WHEN low <= 5 THEN 'bottom' ELSE 'top' END AS part, least(low, high) AS place FROM r WHERE low <= 5 OR high <= 5""")
def top_and_bottom(spark, sf_dir):
    """The five most and the five least important items of each source."""
    w = Window.partitionBy("source")
    ranked = news(spark, sf_dir).select("source", "id", "importance", F.row_number().over(w.orderBy("importance", "id")).alias("low"), F.row_number().over(w.orderBy(F.desc("importance"), "id")).alias("high"))
    own = ranked.where("low <= 5 OR high <= 5")
    return own.select("source", "id", F.when(F.col("low") <= 5, "bottom").otherwise("top").alias("part"), F.least("low", "high").cast("bigint").alias("place"))


@query(f"""{WITH}, a AS (SELECT id, title, {_prefix_sql('title')} AS p FROM news), b AS (SELECT id, title, p, regexp_replace({_POST}, ' ([,.!?;:])', '\\1', 'g') AS done FROM a)
    SELECT id, title AS before, done AS after, p <> title AS prefixes FROM b WHERE done <> title""")
def rewriting_log(spark, sf_dir):
    """What rewriting changed: the title before and after, and whether a prefix went."""
    own = news(spark, sf_dir).select("id", "title", R.without_prefixes(F.col("title"), PREFIXES).alias("p"), R.postprocessed(F.col("title"), PREFIXES, TERMS, CORRECTIONS, PATTERNS).alias("r"))
    return own.where("r.changed").select("id", F.col("title").alias("before"), F.col("r.title").alias("after"), (F.col("p") != F.col("title")).alias("prefixes"))


_RULES = R.rewriting_rules(PREFIXES, TERMS, CORRECTIONS, PATTERNS)
_RULES_SQL = ", ".join(f"({i + 1}, '{k}', '{a}', '{b}')" for i, (k, a, b) in enumerate(_RULES))


@query(f"""WITH RECURSIVE {NEWS_SQL}, rules(pos, kind, old, new) AS (VALUES {_RULES_SQL}),
    steps(id, pos, was, title) AS (SELECT id, 0, title, title FROM news UNION ALL SELECT s.id, r.pos, s.title, CASE WHEN kind = 'prefix' THEN CASE WHEN starts_with(s.title, old) THEN trim(substr(s.title, length(old) + 1)) ELSE s.title END
        WHEN kind = 'term' THEN replace(s.title, old, new) ELSE regexp_replace(s.title, old, new, 'g') END FROM steps s JOIN rules r ON r.pos = s.pos + 1)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS step, kind, old || ' -> ' || new AS change, title FROM steps JOIN rules USING (pos) WHERE title <> was""")
def rewriting_steps(spark, sf_dir):
    """A row for each prefix, term and pattern that changed a title, in order, with what it left."""
    own = news(spark, sf_dir).select("id", F.posexplode(R.rewritten(F.col("title"), _RULES)["log"]).alias("at", "r"))
    return own.select("id", (F.col("at") + 1).cast("bigint").alias("step"), "r.kind", F.concat("r.old", F.lit(" -> "), "r.new").alias("change"), "r.title")


@query(f"""{WITH}, a AS (SELECT id, regexp_replace(regexp_replace(title, 'ing ing', 'ing', 'g'), 'th th', 'th', 'g') AS t, title FROM news),
    i AS (SELECT unnest([CASE WHEN regexp_matches(title, 'ing ing') THEN 'ing ing -> ing' END, CASE WHEN regexp_matches(regexp_replace(title, 'ing ing', 'ing', 'g'), 'th th') THEN 'th th -> th' END,
        CASE WHEN contains(t, 'bank') THEN 'bank: river or money' END, CASE WHEN regexp_matches(t, '\\d') THEN 'a number' END]) AS issue, id FROM a)
    SELECT issue, count(*) AS n, min(id) AS example FROM i WHERE issue IS NOT NULL GROUP BY issue""")
def validation_report(spark, sf_dir):
    """How often each correction and warning occurs in a batch, with an example."""
    v = R.validated(F.col("title"), CORRECTIONS, [("bank", "bank: river or money"), (r"\d", "a number")])
    own = news(spark, sf_dir).select("id", v.alias("v")).select("id", F.explode(F.concat("v.corrections", "v.warnings")).alias("issue"))
    return own.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("example"))


@query("""WITH s AS (SELECT user_id, arg_max(value, ts) AS latest FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT event_id, e.user_id, value FROM events e LEFT JOIN s USING (user_id) WHERE event_type = 'purchase' AND value >= coalesce(s.latest, 50)""")
def alerts_by_setting(spark, sf_dir):
    """Alerts above each user's own threshold, or the usual one."""
    events = table(spark, sf_dir, "events")
    own = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by("value", "ts").alias("least"))
    joined = events.where("event_type = 'purchase'").join(own, "user_id", "left")
    return joined.where(F.col("value") >= F.coalesce("least", F.lit(50.0))).select("event_id", "user_id", "value")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE value END AS importance, 0.5::DOUBLE AS uncertainty, event_type AS sentiment, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS keywords
    FROM events WHERE event_id % 7 <> 0""")
def parsed_answers(spark, sf_dir):
    """Analyses as fenced or bare JSON, with scores or keywords missing; answers that are cut off give no row."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "value", "event_type"))
    fields = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("importance_score"), F.col("event_type").alias("sentiment"), F.when(F.col("event_id") % 4 != 0, F.array(F.lit("a"), "event_type")).alias("keywords")
    )
    events = bound(events, "json", F.to_json(fields))
    json = F.col("json")
    json = F.when(F.col("event_id") % 7 == 0, F.left(json, F.length(json) - 2)).otherwise(json)
    said = F.when(F.col("event_id") % 5 == 0, json).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Here it is: "), json, F.lit(" done"))).otherwise(F.concat(F.lit("So:\n```json\n"), json, F.lit("\n```\nok")))
    own = bound(events, "a", A.analysis(said)).where("a is not null")
    return own.select("event_id", F.col("a.importance_score").alias("importance"), F.col("a.uncertainty_score").alias("uncertainty"), F.col("a.sentiment").alias("sentiment"), F.size("a.keywords").cast("bigint").alias("keywords"))


@query("""SELECT doc_id AS news_id, coalesce(toxic = 1 AND doc_id % 3 > 0, false) AS opinion_conflict, CASE WHEN doc_id % 2 = 0 THEN 'quality ' || quality ELSE '' END AS final_insight FROM labels WHERE doc_id % 11 <> 0""")
def compared_opinions(spark, sf_dir):
    """Comparisons of opinions: the conflict flag and what is said, false and empty where missing; cut answers give no row."""
    own = table(spark, sf_dir, "labels")
    fields = F.struct(
        F.when(F.col("doc_id") % 3 > 0, F.col("toxic") == 1).alias("opinion_conflict"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("final_insight")
    )
    said = F.concat(F.lit("```\n"), F.to_json(fields), F.lit("\n```"))
    said = F.when(F.col("doc_id") % 11 == 0, F.lit('{"opinion_conflict": tr')).otherwise(said)
    read = bound(own.select(F.col("doc_id").alias("news_id"), said.alias("said")), "c", A.comparison(F.col("said"))).where("c is not null")
    return read.select("news_id", "c.opinion_conflict", "c.final_insight")


@query(f"""{WITH} SELECT id, source AS source_section, 'new comment ' || id AS comment_section, CASE WHEN id % 5 = 0 THEN 'a note' ELSE '' END AS note_section FROM news""")
def replaced_sections(spark, sf_dir):
    """Review documents with their comment replaced, and a note put at the end where there was none."""
    number = F.col("id").cast("string")
    own = news(spark, sf_dir).select("id", R.review_document(F.regexp_replace("title", r"\s+", " "), F.col("source"), F.concat(F.lit("old "), number)).alias("md"), F.concat(F.lit("new comment "), number).alias("new"))
    md = R.with_section(F.col("md"), "Comment", F.col("new"))
    md = F.when(F.col("id") % 5 == 0, R.with_section(md, "Note", F.lit("a note"))).otherwise(md)
    done = own.select("id", md.alias("md"))
    return done.select("id", R.section(F.col("md"), "Source").alias("source_section"), R.section(F.col("md"), "Comment").alias("comment_section"), R.section(F.col("md"), "Note").alias("note_section"))
