"""Every query of the document engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, glyphs, values
from quire.functions import text as tx
from quire.operators import assemble, drawing, engines, layout, memory, pages, segment, typeset
from quire.plans import derived, pipeline
from quire.plans.derived import BOXES, GLYPHS, OPS, PAGES, class_names, table
from quire.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; without SQL only its rows are checked."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _map_sql(pairs: dict[str, object]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in pairs.items()) + "}"


LINES = "l AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS para_idx, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


def _protected(pattern: str) -> str:
    return f"""{LINES}, p AS (SELECT *, regexp_extract_all(text, '{pattern}') AS formulas, string_split_regex(text, '{pattern}') AS gaps FROM l),
protected AS (SELECT doc_id, para_idx, text, formulas, array_to_string(list_transform(gaps, lambda g, k: CASE WHEN k < len(gaps) THEN g || '{{v' || CAST(k - 1 AS VARCHAR) || '}}' ELSE g END), '') AS protected FROM p)"""


PROTECTED = _protected("[0-9]+")
STRIP = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}]+|[\s\x{{1c}}-\x{{1f}}]+$', '', 'g')"
SKIP = "(trim(protected, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR regexp_matches(protected, '^\\{v[0-9]+\\}$'))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.lines(table(spark, sf_dir, "documents"))


def _protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.protect(_lines(spark, sf_dir))


# Ingest and plain paragraphs


@query(f"WITH {LINES} SELECT doc_id, para_idx, text FROM l")
def paragraph_split(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"WITH {PROTECTED} SELECT doc_id, para_idx, protected, CAST(len(formulas) AS BIGINT) AS n_formulas FROM protected")
def formula_protect(spark, sf_dir):
    return _protect(spark, sf_dir).select("doc_id", "para_idx", "protected", F.size("formulas").cast("long").alias("n_formulas"))


@query("WITH " + _protected(r"[^\x00-\x7F]+") + " SELECT doc_id, para_idx, protected, CAST(len(formulas) AS BIGINT) AS n_formulas FROM protected")
def formula_protect_nonascii(spark, sf_dir):
    return pipeline.protect(_lines(spark, sf_dir), r"[^\x00-\x7F]+").select("doc_id", "para_idx", "protected", F.size("formulas").cast("long").alias("n_formulas"))


@query(f"WITH {LINES} SELECT doc_id, para_idx, text AS restored FROM l")
def formula_restore(spark, sf_dir):
    rows = pipeline.protect(_lines(spark, sf_dir), r"[^\x00-\x7F]+")
    return rows.select("doc_id", "para_idx", pipeline.restore(F.col("protected"), F.col("formulas")).alias("restored"))


@query(f"WITH {PROTECTED} SELECT doc_id, para_idx, protected FROM protected WHERE NOT {SKIP}")
def translatable_filter(spark, sf_dir):
    return _protect(spark, sf_dir).where(~tx.untranslatable(F.col("protected"))).select("doc_id", "para_idx", "protected")


@query(f"WITH {PROTECTED} SELECT protected AS text, CAST(count(*) AS BIGINT) AS n FROM protected GROUP BY 1")
def distinct_segments(spark, sf_dir):
    return _protect(spark, sf_dir).groupBy(F.col("protected").alias("text")).agg(F.count("*").alias("n"))


# Translation memory


def _engine() -> memory.Engine:
    return memory.Engine("pseudo", "en", "zh", "", memory.pseudo("zh"))


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory of every third document's paragraphs, under the pseudo-engine's key."""
    old = _protect(spark, sf_dir).where("doc_id % 3 = 0").select(F.col("protected").alias("t")).distinct()
    return old.select(F.lit("pseudo").alias("engine"), F.lit(_engine().key).alias("params"), F.col("t").alias("original_text"), F.concat(F.lit("[zh] "), "t").alias("translation"), F.lit(1).cast("long").alias("seq"))


SEED = f"{PROTECTED}, seed AS (SELECT DISTINCT protected AS t FROM protected WHERE doc_id % 3 = 0)"


@query(f"WITH {SEED}, w AS (SELECT DISTINCT protected AS text FROM protected) SELECT text, CASE WHEN t IS NULL THEN NULL ELSE '[zh] ' || t END AS translation FROM w LEFT JOIN seed ON text = t")
def cache_lookup(spark, sf_dir):
    wanted = _protect(spark, sf_dir).select(F.col("protected").alias("text")).distinct()
    return memory.lookup(wanted, _seed(spark, sf_dir), "pseudo", _engine().key)


@query(f"WITH {SEED} SELECT DISTINCT protected AS text FROM protected WHERE protected NOT IN (SELECT t FROM seed)")
def cache_miss_anti(spark, sf_dir):
    wanted = _protect(spark, sf_dir).select(F.col("protected").alias("text"))
    return memory.misses(wanted, _seed(spark, sf_dir), "pseudo", _engine().key)


WRITES = "w AS (SELECT role AS engine, CAST(conv_id % 3 AS VARCHAR) AS params, text AS original_text, CAST(conv_id AS VARCHAR) || ':' || text AS translation, conv_id * 1000 + turn AS seq FROM conversations)"


@query(f"WITH {WRITES} SELECT engine, params, original_text, arg_max(translation, seq) AS translation, max(seq) AS seq FROM w GROUP BY ALL")
def cache_latest_wins(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    rows = conv.select(F.col("role").alias("engine"), (F.col("conv_id") % 3).cast("string").alias("params"), F.col("text").alias("original_text"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), "text").alias("translation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return memory.latest(rows)


@query("""SELECT event_id, '{"event":"' || event_type || '","model":"m' || CAST(user_id % 4 AS VARCHAR) || '","user":"' || CAST(user_id AS VARCHAR) || '"}' AS params FROM events""")
def cache_params_key(spark, sf_dir):
    user = F.col("user_id").cast("string")
    made = F.create_map(F.lit("user"), user, F.lit("event"), F.col("event_type"), F.lit("model"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", memory.canonical_map(made).alias("params"))


@query("""SELECT event_id, '{"model":"new","prompt":"' || event_type || '","user":"' || CAST(user_id AS VARCHAR) || '"}' AS params FROM events""")
def cache_params_merge(spark, sf_dir):
    old = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("model"), F.lit("old"))
    new = F.create_map(F.lit("model"), F.lit("new"), F.lit("prompt"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", memory.canonical_map(memory.merged_map(old, new)).alias("params"))


@query(
    f"""WITH {SEED}, r AS (SELECT doc_id, {SKIP} AS skip, protected IN (SELECT t FROM seed) AS hit, length(text) AS n FROM protected)
SELECT doc_id, CAST(count(*) AS BIGINT) AS paragraphs, CAST(count(*) FILTER (skip) AS BIGINT) AS skipped, CAST(count(*) FILTER (NOT skip AND hit) AS BIGINT) AS hits,
  CAST(count(*) FILTER (NOT skip AND NOT hit) AS BIGINT) AS misses, CAST(sum(n + CASE WHEN skip THEN 0 ELSE 5 END) AS BIGINT) AS chars FROM r GROUP BY doc_id"""
)
def translate_pipeline(spark, sf_dir):
    return pipeline.summary(pipeline.plain(table(spark, sf_dir, "documents"), _engine(), _seed(spark, sf_dir)))


@query(f"WITH {PROTECTED} SELECT doc_id, para_idx, CASE WHEN {SKIP} THEN text ELSE '[zh] ' || text END AS result FROM protected")
def translate_paragraphs(spark, sf_dir):
    return pipeline.plain(table(spark, sf_dir, "documents"), _engine(), _seed(spark, sf_dir), ignore_cache=True).select("doc_id", "para_idx", "result")


# Prompts, requests, answers

TEMPLATE = "From ${lang_in} to ${lang_out}, keep ${unknown}:\n${text}"


@query("SELECT conv_id, turn, 'From ' || role || ' to zh, keep ${unknown}:' || chr(10) || text AS prompt FROM conversations")
def prompt_render(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.render(TEMPLATE, F.col("role"), F.lit("zh"), F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, 'user' AS role, 'From en to ' || role || ', keep ${unknown}:' || chr(10) || text AS content FROM conversations")
def chat_messages(spark, sf_dir):
    said = tx.messages(TEMPLATE, F.lit("en"), F.col("role"), F.col("text"))
    return table(spark, sf_dir, "conversations").withColumn("m", said[0]).select("conv_id", "turn", "m.role", "m.content")


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x9F]', '', 'g') AS clean FROM documents")
def control_strip(spark, sf_dir):
    noisy = F.concat(F.lit("\u0007"), F.col("text"), F.lit("\t\u0085"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.drop_control(noisy).alias("clean"))


@query("SELECT doc_id, CAST(length(substr(text, 1, 5000)) AS BIGINT) AS chars, md5(substr(text, 1, 5000)) AS digest FROM documents")
def truncate_google(spark, sf_dir):
    cut = tx.truncate(F.col("text"), values.GOOGLE_CHARS)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("digest"))


@query("SELECT doc_id, CAST(length(substr(text, 1, 1000)) AS BIGINT) AS chars, md5(substr(text, 1, 1000)) AS digest FROM documents")
def truncate_bing(spark, sf_dir):
    cut = tx.truncate(F.col("text"), values.BING_CHARS)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("digest"))


THOUGHT = "CASE turn % 3 WHEN 0 THEN '<think>' || text || chr(10) || '</think>' || text || ' <think>x</think>' WHEN 1 THEN text ELSE '<think>a' || chr(10) || '</think>' || chr(10) || '</think>' || text END"


def _thought():
    t = F.col("text")
    return F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), t, F.lit("\n</think>"), t, F.lit(" <think>x</think>"))).when(F.col("turn") % 3 == 1, t).otherwise(F.concat(F.lit("<think>a\n</think>\n</think>"), t))


@query(f"SELECT conv_id, turn, regexp_replace({THOUGHT}, '(?s)^<think>.+?</think>', '') AS answer FROM conversations")
def cot_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.drop_thought(_thought()).alias("answer"))


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace({THOUGHT}, '(?s)^<think>.+?\\n*(</think>|\\n)*(</think>)\\n*', ''), '^\\s+|\\s+$', '', 'g') AS answer FROM conversations")
def cot_strip_tolerant(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.drop_thought_tolerant(_thought()).alias("answer"))


@query("SELECT conv_id, turn, replace(text || '<end_of_turn>', '<end_of_turn>', '') AS answer FROM conversations")
def end_of_turn_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.drop_end_of_turn(F.concat("text", F.lit("<end_of_turn>"))).alias("answer"))


@query("SELECT doc_id, length(text) * 6 > greatest(2000, 5 * length(text)) AS rejected FROM documents")
def response_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.too_long(F.repeat("text", F.lit(6)), F.col("text")).alias("rejected"))


@query("SELECT doc_id, CAST(greatest(2000, 5 * length(text)) AS BIGINT) AS tokens FROM documents")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_budget(F.col("text")).cast("long").alias("tokens"))


HEADING = "(?s)<h1>(.*?)<"


@query(f"SELECT page_id, regexp_extract_all(html, '{HEADING}', 1)[1] AS first, regexp_extract_all(html, 'href=\"(.*?)\"', 1)[-1] AS last, CAST(len(regexp_extract_all(html, 'href=\"(.*?)\"', 1)) AS BIGINT) AS n FROM pages")
def html_result_extract(spark, sf_dir):
    html, link = F.col("html"), 'href="(.*?)"'
    return table(spark, sf_dir, "pages").select("page_id", tx.first_capture(html, HEADING).alias("first"), tx.last_capture(html, link).alias("last"), F.size(tx.captures(html, link)).cast("long").alias("n"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') AS plain FROM pages""")
def html_unescape_basic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.unescape_basic(F.col("html")).alias("plain"))


@query()
def html_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.unescape(F.col("html")).alias("plain"))


# Languages, services, fonts


@query("SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 'en-GB' WHEN 'fr' THEN 'fr-CA' ELSE lang END AS code FROM documents")
def lang_alias(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.language_alias(F.col("lang"), {"en": "en-GB", "fr": "fr-CA"}).alias("code"))


@query(f"SELECT n_nationkey, [{', '.join(repr(k) for k in values.LANGUAGE_CODES)}][n_nationkey % 10 + 1] AS name, [{', '.join(repr(v) for v in values.LANGUAGE_CODES.values())}][n_nationkey % 10 + 1] AS code FROM nation")
def lang_name_to_code(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(k) for k in values.LANGUAGE_CODES]), (F.col("n_nationkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"), tx.language_code(name).alias("code"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS word FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def lang_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr", "de", "es")).select("doc_id", tx.language_word(F.col("lang")).alias("word"))


@query("SELECT p_partkey, p_brand AS name, p_type || ':' || CAST(p_size AS VARCHAR) AS model FROM part")
def service_split(spark, sf_dir):
    spec = F.concat("p_brand", F.lit(":"), "p_type", F.lit(":"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.service_parts(spec).alias("s")).select("p_partkey", "s.name", "s.model")


@query("SELECT * FROM (VALUES (-2, 'Google'), (-1, 'Bing'), (2, 'DeepL'), (7, 'OpenAI'), (16, 'Argos Translate')) t(position, name)")
def service_enabled(spark, sf_dir):
    named = spark.createDataFrame(list(enumerate(values.SERVICE_NAMES)), "position int, name string")
    return pages.enabled_services(spark, named, [" openai", "DEEPL", "argos translate ", "none such"])


@query(f"SELECT name, CAST(max_chars AS INTEGER) AS max_chars, cacheable FROM (VALUES {', '.join(f'({n!r}, {dict(google=5000, bing=1000).get(n, chr(78) + chr(85) + chr(76) + chr(76))}, {str(s.get(chr(99) + "acheable", True)).lower()})' for n, s in engines.SERVICES.items())}) t(name, max_chars, cacheable)")
def service_registry(spark, sf_dir):
    return engines.registry(spark).select("name", "max_chars", "cacheable")


_TARGETS = ["zh", "zh-TW", "ja", "KO", "ru", "ar", "en", "xx"]
_FONTS = {"zh": "SourceHanSerifCN-Regular.ttf", "zh-TW": "SourceHanSerifTW-Regular.ttf", "ja": "SourceHanSerifJP-Regular.ttf", "KO": "SourceHanSerifKR-Regular.ttf"}
_HEIGHTS = {"zh": 1.4, "zh-TW": 1.4, "ja": 1.1, "KO": 1.2, "ru": 0.8, "ar": 1.0, "en": 1.2, "xx": 1.1}


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in _TARGETS]), (F.col("c_custkey") % 8 + 1).cast("int")).alias("lang"))


@query(f"SELECT c_custkey, [{', '.join(repr(_FONTS.get(x, values.PAN_SCRIPT_FONT)) for x in _TARGETS)}][c_custkey % 8 + 1] AS font FROM customer")
def font_for_lang(spark, sf_dir):
    return _targets(spark, sf_dir).select("c_custkey", tx.font_file(F.col("lang")).alias("font"))


@query(f"SELECT c_custkey, CAST([{', '.join(str(_HEIGHTS[x]) for x in _TARGETS)}][c_custkey % 8 + 1] AS DOUBLE) AS height FROM customer")
def line_height_for_lang(spark, sf_dir):
    return _targets(spark, sf_dir).select("c_custkey", tx.line_height(F.col("lang")).alias("height"))


# Pages


@query("SELECT p_partkey, array_to_string(list_concat(list_concat(range(p_size - 1, p_size + 3), [p_size - 1]), range(8, p_size)), ',') AS pages FROM (SELECT p_partkey, CAST(p_size AS INTEGER) AS p_size FROM part)")
def page_range_parse(spark, sf_dir):
    n = F.col("p_size").cast("string")
    spec = F.concat(n, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(","), n, F.lit(",9-"), n)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(pages.parse_ranges(spec), lambda x: x.cast("string")), ",").alias("pages"))


@query(f"WITH {PAGES} SELECT doc_id, pageno FROM pages_ WHERE pageno IN (0, 2, 5)")
def page_filter_semi(spark, sf_dir):
    wanted = spark.createDataFrame([(0,), (2,), (5,), (2,)], "pageno int")
    return pages.select(derived.page_keys(table(spark, sf_dir, "documents")), wanted)


@query(f"WITH {PAGES} SELECT doc_id, pageno FROM pages_ WHERE pageno < 5")
def page_presets(spark, sf_dir):
    return pages.preset(derived.page_keys(table(spark, sf_dir, "documents")), "First 5 pages")


@query(f"WITH {PAGES} SELECT doc_id, CAST(CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 ELSE count(*) END AS BIGINT) AS total FROM pages_ GROUP BY doc_id")
def progress_total(spark, sf_dir):
    counted = derived.page_keys(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))
    wanted = F.slice(F.array(F.lit(0), F.lit(0), F.lit(9)), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    return counted.select("doc_id", pages.progress_total(wanted, F.col("n")).alias("total"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events")
def job_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pageno"))
    return assemble.progress(rows).select(F.col("doc_id").alias("user_id"), F.col("pageno").alias("event_id"), "n")


# Glyphs


@query(f"WITH {GLYPHS} SELECT doc_id, pageno, CAST(count(*) AS BIGINT) AS n, sum(x0) AS sum_x0, sum(y1) AS sum_y1, sum(size) AS sum_size, min(seq) AS first_seq, CAST(count(DISTINCT ch) AS BIGINT) AS chars FROM glyphs GROUP BY ALL")
def glyph_explode(spark, sf_dir):
    g = derived.glyphs(table(spark, sf_dir, "documents"))
    return g.groupBy("doc_id", "pageno").agg(F.count("*").alias("n"), F.sum("x0").alias("sum_x0"), F.sum("y1").alias("sum_y1"), F.sum("size").alias("sum_size"), F.min("seq").alias("first_seq"), F.count_distinct("ch").alias("chars"))


@query(f"WITH {GLYPHS} SELECT ch, CAST(count(*) AS BIGINT) AS n, ch <> ' ' AND regexp_matches(ch, '^[\\p{{Lm}}\\p{{Mn}}\\p{{Sk}}\\p{{Sm}}\\p{{Zl}}\\p{{Zp}}\\p{{Zs}}\\x{{370}}-\\x{{3ff}}]') AS formula FROM glyphs GROUP BY ch")
def formula_char_class(spark, sf_dir):
    counted = derived.glyphs(table(spark, sf_dir, "documents")).groupBy("ch").agg(F.count("*").alias("n"))
    return counted.withColumn("formula", glyphs.formula_char(F.col("ch")))


_NAMED = ["CMMI10", "CMR10", "Times-Italic", "Helvetica", "XYZ", "MTMI", "EU", "Fira Code"]


@query(f"SELECT p_partkey, [true, false, true, false, true, true, true, true][p_partkey % 8 + 1] AS formula FROM part")
def formula_font_class(spark, sf_dir):
    font = F.concat(F.lit("ABCDEF+"), F.element_at(F.array(*[F.lit(x) for x in _NAMED]), (F.col("p_partkey") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", glyphs.formula_font(font).alias("formula"))


@query("SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: printf(CASE WHEN turn % 2 = 0 THEN '%04x' ELSE '%02x' END, unicode(c))), '') AS codes FROM conversations")
def glyph_hex_encode(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", glyphs.encoded(F.col("text"), F.col("turn") % 2 == 0).alias("codes"))


@query("SELECT p_partkey, p_size % 3 = 0 AND p_partkey % 2 = 0 AS vertical FROM part")
def vertical_glyphs(spark, sf_dir):
    a, d = F.col("p_size") % 3, F.col("p_partkey") % 2
    return table(spark, sf_dir, "part").select("p_partkey", glyphs.vertical(a.cast("double"), d.cast("double")).alias("vertical"))


@query(f"WITH {GLYPHS} SELECT ch, CAST(count(*) AS BIGINT) AS n, regexp_matches(ch, '^[\\p{{Lm}}\\p{{Mn}}\\p{{Sk}}]') AS modifier FROM glyphs GROUP BY ch")
def modifier_class(spark, sf_dir):
    counted = derived.glyphs(table(spark, sf_dir, "documents")).groupBy("ch").agg(F.count("*").alias("n"))
    return counted.withColumn("modifier", glyphs.modifier(F.col("ch")))


@query("SELECT l_orderkey, l_linenumber, printf('/%s %f Tf 1 0 0 1 %f %f Tm [<%s>] TJ ', l_shipmode_, l_quantity, l_extendedprice, l_tax, lower(l_returnflag)) AS op FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'tiro' ELSE 'noto' END AS l_shipmode_ FROM lineitem)")
def text_operator(spark, sf_dir):
    font = F.when(F.col("l_linenumber") % 2 == 0, "tiro").otherwise("noto")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", glyphs.text_op(font, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), F.lower("l_returnflag")).alias("op"))


@query("SELECT l_orderkey, l_linenumber, printf('ET q 1 0 0 1 %f %f cm [] 0 d 0 J %f w 0 0 m %f %f l S Q BT ', l_quantity, l_extendedprice, l_tax, l_discount, -l_quantity) AS op FROM lineitem")
def line_operator(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", glyphs.line_op(c("l_quantity"), c("l_extendedprice"), c("l_discount"), -c("l_quantity"), c("l_tax")).alias("op"))


# Layout


@query(f"WITH {BOXES} SELECT doc_id, pageno, det_idx, conf, CAST(row_number() OVER (PARTITION BY doc_id, pageno ORDER BY conf DESC, det_idx) - 1 AS INTEGER) AS i FROM boxes WHERE conf > 0.25 AND NOT isnan(conf)")
def bbox_filter_rank(spark, sf_dir):
    return layout.ranked(layout.confident(derived.boxes(table(spark, sf_dir, "documents")))).select("doc_id", "pageno", "det_idx", "conf", "i")


@query(
    f"""WITH {BOXES}, g AS (SELECT *, least(1024 / 500.0::DOUBLE, 1024 / CAST(200 + doc_id % 400 AS DOUBLE)) AS gain FROM boxes),
p AS (SELECT *, round_even((1024 - (200 + doc_id % 400) * gain) / 2 - 0.1, 0) AS px, round_even((1024 - 500 * gain) / 2 - 0.1, 0) AS py FROM g)
SELECT doc_id, pageno, det_idx, (x0 - px) / gain AS x0, (y0 - py) / gain AS y0, (x1 - px) / gain AS x1, (y1 - py) / gain AS y1 FROM p"""
)
def bbox_rescale(spark, sf_dir):
    box = geometry.unscaled(F.array("x0", "y0", "x1", "y1"), F.lit(1024.0), F.lit(1024.0), F.lit(500.0), (200 + F.col("doc_id") % 400).cast("double"))
    rows = derived.boxes(table(spark, sf_dir, "documents")).withColumn("b", box)
    return rows.select("doc_id", "pageno", "det_idx", *[F.col("b")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    """WITH s AS (SELECT p_partkey, 100 + p_size * 7 AS h, 100 + p_partkey % 900 AS w FROM part),
r AS (SELECT *, least(1024 / CAST(h AS DOUBLE), 1024 / CAST(w AS DOUBLE)) AS ratio FROM s),
d AS (SELECT *, CAST(round_even(h * ratio, 0) AS INTEGER) AS height, CAST(round_even(w * ratio, 0) AS INTEGER) AS width FROM r)
SELECT p_partkey, height, width, CAST(((1024 - height) % 32) // 2 AS INTEGER) AS top, CAST((1024 - height) % 32 - ((1024 - height) % 32) // 2 AS INTEGER) AS bottom,
  CAST(((1024 - width) % 32) // 2 AS INTEGER) AS "left", CAST(h // 32 * 32 AS INTEGER) AS network FROM d"""
)
def image_geometry(spark, sf_dir):
    h, w = 100 + F.col("p_size") * 7, 100 + F.col("p_partkey") % 900
    rows = table(spark, sf_dir, "part").withColumn("g", geometry.resized(h.cast("double"), w.cast("double"), F.lit(1024), 32))
    return rows.select("p_partkey", "g.height", "g.width", "g.top", "g.bottom", "g.left", geometry.network_size(h).alias("network"))


CLASSED = f"""{GLYPHS}, {BOXES},
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pageno ORDER BY conf DESC, det_idx) - 1 AS i FROM boxes WHERE conf > 0.25),
r AS (SELECT doc_id, pageno, i, cls IN (2, 3, 5, 6, 7) AS excluded,
  greatest(0, least(CAST(trunc(x0 - 1) AS INTEGER), 479)) AS bx0, greatest(0, least(CAST(trunc(792 - y1 - 1) AS INTEGER), 791)) AS by0,
  greatest(0, least(CAST(trunc(x1 + 1) AS INTEGER), 479)) AS bx1, greatest(0, least(CAST(trunc(792 - y0 + 1) AS INTEGER), 791)) AS by1 FROM b),
classed AS (SELECT g.doc_id, g.pageno, g.seq, any_value(g.x0) AS x0, any_value(g.x1) AS x1,
  CAST(CASE WHEN any_value(g.ch) = '•' THEN 0 WHEN coalesce(bool_or(excluded), false) THEN 0 ELSE coalesce(max(i) + 2, 1) END AS INTEGER) AS cls
  FROM glyphs g LEFT JOIN r ON g.doc_id = r.doc_id AND g.pageno = r.pageno AND least(g.x0, 479) >= bx0 AND least(g.x0, 479) < bx1 AND least(g.y0, 791) >= by0 AND least(g.y0, 791) < by1
  GROUP BY g.doc_id, g.pageno, g.seq)"""


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return layout.with_document_boxes(docs, derived.boxes(docs), class_names(spark), derived.PAGE_WIDTH, derived.PAGE_HEIGHT)


@query(f"WITH {CLASSED} SELECT doc_id, pageno, cls, CAST(count(*) AS BIGINT) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM classed GROUP BY ALL")
def layout_class_join(spark, sf_dir):
    classed = layout.spots(_boxed(spark, sf_dir), derived.read_pages)
    spots = classed.select("doc_id", "pageno", F.explode(F.arrays_zip("cls", "seq")).alias("g"))
    return spots.groupBy("doc_id", "pageno", F.col("g.cls").alias("cls")).agg(F.count("*").alias("n"), F.sum("g.seq").alias("seqs"))


ISLANDS = f"{GLYPHS}, k AS (SELECT *, (seq // 97) % 3 AS cls FROM glyphs), s AS (SELECT *, CASE WHEN lag(cls) OVER w IS DISTINCT FROM cls THEN 1 ELSE 0 END AS start FROM k WINDOW w AS (PARTITION BY doc_id, pageno ORDER BY seq)), i AS (SELECT *, CAST(sum(start) OVER (PARTITION BY doc_id, pageno ORDER BY seq) - 1 AS INTEGER) AS para_idx FROM s)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.runs(derived.spread(table(spark, sf_dir, "documents")), derived.read_classed)


@query(f"WITH {ISLANDS} SELECT doc_id, pageno, para_idx, CAST(count(*) AS BIGINT) AS n, min(seq) AS first_seq FROM i GROUP BY ALL")
def paragraph_islands(spark, sf_dir):
    return _runs(spark, sf_dir).select("doc_id", "pageno", "para_idx", F.col("glyphs").alias("n"), "first_seq")


@query(f"WITH {ISLANDS} SELECT doc_id, pageno, para_idx, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, CAST(count(*) AS BIGINT) AS glyphs FROM i GROUP BY ALL")
def paragraph_bounds(spark, sf_dir):
    return _runs(spark, sf_dir).select("doc_id", "pageno", "para_idx", "x0", "x1", "y0", "y1", "glyphs")


@query(
    f"""WITH {ISLANDS}, g AS (SELECT *, coalesce(x0 > lag(x1) OVER w + 1, false) AS gap, coalesce(x1 < lag(x0) OVER w, false) AS back FROM i WINDOW w AS (PARTITION BY doc_id, pageno, para_idx ORDER BY seq))
SELECT doc_id, pageno, CAST(count(*) FILTER (gap OR back) AS BIGINT) AS spaces, CAST(count(*) FILTER (back AND NOT gap) AS BIGINT) AS wraps FROM g GROUP BY ALL"""
)
def space_insertion(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("doc_id", "pageno").agg(F.sum("spaces").alias("spaces"), F.sum("wraps").alias("wraps"))


@query(f"WITH {GLYPHS}, v AS (SELECT *, seq // 12 AS vid FROM glyphs WHERE font <> 'Times') SELECT doc_id, pageno, vid, max(x1) - arg_min(x0, seq) AS width, CAST(count(*) AS BIGINT) AS glyphs FROM v GROUP BY ALL")
def formula_width(spark, sf_dir):
    g = derived.glyphs(table(spark, sf_dir, "documents")).where("font <> 'Times'").withColumn("vid", F.floor(F.col("seq") / 12))
    return segment.formula_widths(g)


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(_boxed(spark, sf_dir), float(derived.PAGE_WIDTH), read=derived.read_pages)


@query()
def segment_fold(spark, sf_dir):
    return _segmented(spark, sf_dir).select("doc_id", "pageno", F.posexplode("paragraphs").alias("k", "p")).select("doc_id", "pageno", "p.para_idx", "p.text", "p.brk", "p.size", "p.x0", "p.x1")


@query()
def typeset_fold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    metrics = typeset.Metrics({c: 0.5 for c in range(32, 127)}, {}, 0.6)
    from quire.plans.options import Options

    out = pipeline.translate_pages(docs.select("doc_id", "text"), derived.boxes(docs), class_names(spark), _engine(), Options(lang_out="zh", service="pseudo"), metrics, read=derived.read_pages)
    return out.select("doc_id", "pageno", F.length("ops").cast("long").alias("length"), F.md5("ops").alias("digest"))


# Typesetting


@query("SELECT l_orderkey, l_linenumber, list_reduce(list_prepend(1.4::DOUBLE, list_transform(range(12), lambda k: 0.0::DOUBLE)), lambda lh, k: CASE WHEN (l_linenumber * 10.0::DOUBLE * lh > l_quantity) AND lh >= 1.0 THEN lh - 0.05::DOUBLE ELSE lh END) AS height FROM lineitem")
def line_height_shrink(spark, sf_dir):
    height = geometry.shrunk_line_height(F.col("l_quantity"), F.col("l_linenumber"), F.lit(10.0), F.lit(1.4))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", height.alias("height"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, text, 30 AS x, 0 AS line, 0 AS k FROM conversations
  UNION ALL SELECT conv_id, turn, text, CASE WHEN (x + 6 > 241 OR x = 0) AND substr(text, k + 1, 1) = ' ' THEN 0 WHEN x + 6 > 241 THEN 6 ELSE x + 6 END,
    CASE WHEN x + 6 > 241 THEN line + 1 ELSE line END, k + 1 FROM t WHERE k < length(text))
SELECT conv_id, turn, CAST(max(line) FILTER (k > 0) AS INTEGER) AS last_line, CAST(max(k) AS INTEGER) AS chars FROM t GROUP BY conv_id, turn"""
)
def greedy_wrap(spark, sf_dir):
    lines = typeset.wrapped(F.col("text"), F.lit(6.0), F.lit(30.0), F.lit(0.0), F.lit(240.0), F.lit(10.0), F.lit(True))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_max(lines).alias("last_line"), F.size(lines).alias("chars"))


@query(f"WITH {PROTECTED} SELECT doc_id, para_idx, CAST(len(regexp_extract_all(protected, '(?is)\\{{\\s*v[0-9\\s]+\\}}|.')) AS BIGINT) AS pieces, CAST(len(formulas) AS BIGINT) AS marks FROM protected")
def typeset_pieces(spark, sf_dir):
    rows = _protect(spark, sf_dir)
    return rows.select("doc_id", "para_idx", F.size(typeset.pieces(F.col("protected"))).cast("long").alias("pieces"), F.size(tx.placeholder_numbers(F.col("protected"))).cast("long").alias("marks"))


@query(f"WITH {GLYPHS} SELECT doc_id, pageno, CASE WHEN unicode(ch) < 128 THEN 'tiro' ELSE 'noto' END AS font, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN unicode(ch) < 128 THEN 5 ELSE 6 END) AS BIGINT) AS advance FROM glyphs GROUP BY ALL")
def font_choice(spark, sf_dir):
    point = F.ascii("ch")
    g = derived.glyphs(table(spark, sf_dir, "documents")).withColumn("wide", point >= 128)
    font = typeset.font_choice(point, ~F.col("wide"))
    return g.groupBy("doc_id", "pageno", font.alias("font")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("wide"), 6).otherwise(5)).alias("advance"))


@query("SELECT l_orderkey, l_linenumber, '<b' || l_linenumber || '>' AS left_mark, '</b' || l_linenumber || '>' AS right_mark, '{{v' || (l_linenumber + 1) || '}}' AS after FROM lineitem")
def rich_text_marks(spark, sf_dir):
    n = F.col("l_linenumber")
    tags = tx.rich_text_marks(n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tags["left"].alias("left_mark"), tags["right"].alias("right_mark"), tx.rich_text_marks(n, "braces")["right"].alias("after"))


# Drawing operators and assembly


@query(
    f"""WITH {OPS} SELECT doc_id, obj_id, string_agg(CASE WHEN stroke THEN 'n S ' ELSE said || ' ' || op || ' ' END, '' ORDER BY seq) AS ops FROM ops
WHERE op <> 'zz' AND op NOT LIKE 'T%' AND op NOT IN ('"', '''', 'EI', 'MP', 'DP', 'BMC', 'BDC', 'BI', 'ID', 'EMC') GROUP BY doc_id, obj_id"""
)
def op_passthrough(spark, sf_dir):
    return drawing.base_stream(derived.ops(table(spark, sf_dir, "lineitem")).withColumnRenamed("stroke", "kept"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AND l_quantity = l_linenumber * 5 AND l_partkey % 3 = 0 AS kept FROM lineitem")
def stroke_filter(spark, sf_dir):
    point = lambda op, x, y: F.struct(F.lit(op).alias("op"), x.alias("x"), y.alias("y"))
    x, y = F.col("l_suppkey").cast("double"), F.col("l_quantity")
    two = F.array(point("m", x, y), point("l", x + 10, (F.col("l_linenumber") * 5).cast("double")))
    path = F.when(F.col("l_linenumber") % 2 == 0, two).otherwise(F.concat(two, F.array(point("l", x, y))))
    color = F.array((F.col("l_partkey") % 3).cast("double"), F.lit(0.0), F.lit(0.0))
    ctm = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, -5.0, 7.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", drawing.layout_stroke(path, ctm, color).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 AND l_suppkey % 2 = 0 AS black FROM lineitem")
def black_test(spark, sf_dir):
    color = F.array((F.col("l_linenumber") % 3).cast("double"), (F.col("l_suppkey") % 2).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", drawing.black(color).alias("black"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS linewidth FROM lineitem WHERE l_quantity < 5")
def thin_lines(spark, sf_dir):
    return drawing.thin(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("linewidth")))


@query("SELECT c_custkey, try_cast(c_name AS DOUBLE) AS named, CAST(coalesce(try_cast(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS INTEGER), 1) AS INTEGER) AS threads FROM customer")
def tolerant_numbers(spark, sf_dir):
    said = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.number(F.col("c_name")).alias("named"), tx.threads(said).alias("threads"))


@query(
    """WITH c AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 50 AS DOUBLE) AS y0, p_size + 600.0::DOUBLE AS x1, p_partkey % 50 + 800.0::DOUBLE AS y1, p_partkey % 5 * 90 AS r FROM part)
SELECT p_partkey, CAST(CASE r WHEN 90 THEN 0 WHEN 180 THEN -1 WHEN 270 THEN 0 ELSE 1 END AS DOUBLE) AS a, CAST(CASE r WHEN 90 THEN -1 WHEN 270 THEN 1 ELSE 0 END AS DOUBLE) AS b,
  CASE r WHEN 90 THEN -y0 WHEN 180 THEN x1 WHEN 270 THEN y1 ELSE -x0 END AS e, CASE r WHEN 90 THEN x1 WHEN 180 THEN y1 WHEN 270 THEN -x0 ELSE -y0 END AS f,
  CASE WHEN r IN (90, 270) THEN 800.0::DOUBLE ELSE 600.0::DOUBLE END AS width FROM c"""
)
def page_ctm(spark, sf_dir):
    x0, y0 = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    ctm = geometry.page_ctm(F.col("p_partkey") % 5 * 90, x0, y0, x0 + 600.0, y0 + 800.0)
    rows = table(spark, sf_dir, "part").withColumn("ctm", ctm)
    return rows.select("p_partkey", *[F.col("ctm")[k].alias(c) for k, c in ((0, "a"), (1, "b"), (4, "e"), (5, "f"))], geometry.extent(F.col("ctm"), x0, y0, x0 + 600.0, y0 + 800.0)["width"].alias("width"))


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS a, CAST(l_partkey % 3 AS DOUBLE) AS b, CAST(l_suppkey % 2 AS DOUBLE) AS c, CAST(l_linenumber % 4 AS DOUBLE) AS d, CAST(l_partkey AS DOUBLE) AS e, CAST(l_suppkey AS DOUBLE) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, 2 * (a * 3 + c * 5 + e) AS x, CASE WHEN a * d - b * c <> 0 THEN d / (a * d - b * c) END AS inverse_a, CASE WHEN a * d - b * c <> 0 THEN -(e * (d / (a * d - b * c)) + f * (-c / (a * d - b * c))) END AS inverse_e FROM m"""
)
def matrix_algebra(spark, sf_dir):
    m = F.array(*[c.cast("double") for c in (F.col("l_linenumber"), F.col("l_partkey") % 3, F.col("l_suppkey") % 2, F.col("l_linenumber") % 4, F.col("l_partkey"), F.col("l_suppkey"))])
    double = F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 2.0, 0.0, 0.0)])
    rows = table(spark, sf_dir, "lineitem").withColumn("m", m).withColumn("i", geometry.inverse(F.col("m")))
    return rows.select("l_orderkey", "l_linenumber", geometry.apply(geometry.product(F.col("m"), double), F.lit(3.0), F.lit(5.0))["x"].alias("x"), F.col("i")[0].alias("inverse_a"), F.col("i")[4].alias("inverse_e"))


@query(
    f"""WITH p AS (SELECT l_orderkey AS obj_id, arg_max(CAST(l_partkey AS VARCHAR), {derived.SEQUENCE}) AS ops FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT o_custkey % 50 AS doc_id, o_orderkey AS obj_id, coalesce(p.ops, o_orderstatus) AS ops, p.ops IS NOT NULL AS patched FROM orders LEFT JOIN p ON o_orderkey = obj_id"""
)
def patch_apply(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("obj_id"), F.col("o_orderstatus").alias("ops"))
    written = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("obj_id"), F.col("l_partkey").cast("string").alias("ops"), derived.sequence().alias("seq"))
    return assemble.apply_patches(objects, objects.select("doc_id", "obj_id").join(written, "obj_id"))


@query(
    """WITH RECURSIVE f AS (SELECT p_partkey AS form, p_partkey // 4 AS parent, CAST(p_size AS DOUBLE) AS dx FROM part WHERE p_partkey > 0),
t AS (SELECT form AS page, form, 0 AS depth, dx FROM f WHERE form <= 3
  UNION ALL SELECT t.page, f.form, t.depth + 1, t.dx + f.dx FROM t JOIN f ON f.parent = t.form AND f.form <> t.form)
SELECT page, form, depth, dx FROM t"""
)
def form_tree(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    matrix = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("p_size").cast("double"), F.lit(0.0))
    forms = part.select(F.lit(1).alias("doc_id"), F.floor(F.col("p_partkey") / 4).cast("long").alias("parent"), F.col("p_partkey").alias("form"), matrix.alias("matrix"))
    roots = forms.where("form <= 3").withColumn("page", F.col("form"))
    return drawing.form_tree(forms, roots).select("page", "form", "depth", F.col("matrix")[4].alias("dx"))


@query("SELECT o_orderkey AS obj_id, 'q ' || o_orderstatus || ' Q 1 0 0 1 ' || o_custkey || ' 7 cm ' || o_orderpriority AS ops FROM orders")
def page_patch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("obj_id"), drawing.page_patch(F.concat("o_orderstatus", F.lit(" ")), F.col("o_custkey"), F.lit(7), F.col("o_orderpriority")).alias("ops"))


@query(f"WITH {PAGES} SELECT doc_id, pageno, 'original' AS side, 2 * pageno AS position FROM pages_ UNION ALL SELECT doc_id, pageno, 'translated', 2 * pageno + 1 FROM pages_")
def dual_interleave(spark, sf_dir):
    keys = derived.page_keys(table(spark, sf_dir, "documents"))
    return assemble.interleaved(keys, keys)


@query(f"WITH {PAGES} SELECT doc_id, pageno, unnest(['tiro', 'noto']) AS font FROM pages_")
def page_fonts(spark, sf_dir):
    return assemble.fonts_of_pages(derived.page_keys(table(spark, sf_dir, "documents")), ("tiro", "noto"))


@query(f"WITH {GLYPHS} SELECT doc_id, font, CAST(count(DISTINCT ch) AS BIGINT) AS chars, array_to_string(list_sort(list(DISTINCT ch)), '') AS charset FROM glyphs GROUP BY doc_id, font")
def charset_per_font(spark, sf_dir):
    return assemble.charset_of_pages(derived.spread(table(spark, sf_dir, "documents")), derived.read_pages)


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'q ' || p_name || 'Q ' || CAST(1 / s AS VARCHAR) || ' ' || CAST(-0.0::DOUBLE / (s * s) AS VARCHAR) || ' ' || CAST(-0.0::DOUBLE / (s * s) AS VARCHAR) || ' ' || CAST(1 / s AS VARCHAR) || ' ' || CAST(-x / s AS VARCHAR) || ' ' || CAST(-y / s AS VARCHAR) || ' cm BT' END AS ops FROM (SELECT *, power(2, p_size % 4)::DOUBLE AS s, (p_partkey % 9 + 1)::DOUBLE AS x, (p_size + 1)::DOUBLE AS y FROM part)")
def form_patches(spark, sf_dir):
    s = F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("p_size") % 4))
    none = F.lit(0.0)
    ctm = F.array(s, none, none, s, (F.col("p_partkey") % 9 + 1).cast("double"), (F.col("p_size") + 1).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", drawing.form_patch(F.col("p_name"), ctm, F.lit("BT")).alias("ops"))


@query(f"WITH {OPS}, k AS (SELECT *, op IN ('q', 'Q', 're', 'cm', 'S', 'BT', 'Do', 'l', 'm', 'w') AS passed FROM ops) SELECT obj_id, string_agg(CASE WHEN op = 'S' AND stroke THEN 'n S ' ELSE said || ' ' || op || ' ' END, '' ORDER BY seq, CASE WHEN op = 'S' AND stroke THEN 'n S ' ELSE said || ' ' || op || ' ' END) AS ops FROM k WHERE passed GROUP BY obj_id")
def base_streams(spark, sf_dir):
    rows = derived.ops(table(spark, sf_dir, "lineitem")).withColumn("kept", F.col("stroke") & (F.col("op") == "S"))
    return drawing.base_stream(rows, ("obj_id",))


# Files


@query("SELECT page_id, 'out/' || stem || '-mono.pdf' AS mono, 'out/' || stem || '-dual.pdf' AS dual FROM (SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages)")
def output_names(spark, sf_dir):
    return files.with_output_names(table(spark, sf_dir, "pages"), "out", "url").select("page_id", "mono", "dual")


@query("SELECT page_id, url FROM pages WHERE page_id % 7 = 0 AND page_id % 2 = 1")
def missing_files_anti(spark, sf_dir):
    # Pages may share an address, so a file is named by its page; the address goes along.
    local = F.concat(F.lit("/data/"), "page_id", F.lit(".pdf"))
    pages_ = table(spark, sf_dir, "pages").where("page_id is not null")
    wanted = pages_.select("page_id", "url", F.when(F.col("page_id") % 2 == 1, local).otherwise(F.concat(F.lit("https://x/"), "page_id")).alias("path"))
    present = wanted.where("page_id % 7 <> 0")
    return files.missing(wanted, present).select("page_id", "url")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'report' ELSE regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '(.)\\.[^.]*$', '\\1') END || '.pdf' AS name FROM pages")
def download_name(spark, sf_dir):
    said = F.when(F.col("page_id") % 3 == 0, F.lit('attachment; filename="report.html"'))
    return table(spark, sf_dir, "pages").select("page_id", files.download_name(F.col("url"), said).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE html END AS content FROM pages")
def result_pick(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "mono").when(F.col("page_id") % 3 == 1, "dual").otherwise("other")
    return files.pick(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("mono"), F.col("html").alias("dual")), kind).select("page_id", "content")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '***' ELSE c_name END AS shown, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS kept FROM customer")
def api_key_mask(spark, sf_dir):
    label = F.when(F.col("c_custkey") % 3 == 0, "X_Api_Key").otherwise("X_MODEL")
    rows = table(spark, sf_dir, "customer").withColumn("shown", tx.masked(label, F.col("c_name")))
    return rows.select("c_custkey", "shown", tx.masked(label, F.col("shown"), F.col("c_mktsegment")).alias("kept"))
