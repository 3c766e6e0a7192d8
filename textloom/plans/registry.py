"""All queries of the text-checking engine, by name, with their reference SQL.

Documents of the test tables hold no Khmer, so Khmer rules run on an overlay: one of a few Khmer lines
by doc_id, a line feed, and the document. Queries that have SQL over the first 40 characters of the document
(OVERLAY_SQL) keep to it; each has a query of the same name with ``_whole`` over the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chars, meaning, normalize, spans, tokens
from textloom.operators import consistency, evaluation, findings, punctuation, review, rules, sentences, spelling, surface, terms, words
from textloom.operators import lexicon as lex

LINES = (
    "ខ្ញុំទៅផ្សារ។។ គាត់មក!!",
    "គេ ៗ​​ និយាយ , ហើយៗៗ «ពាក្យ",
    "ឆ្នាំ២០២៤ និង 2024 និង/ឬ ៥ »",
    "‪អក្សរ‬ � ៘ បញ្ចប់??",
    "កាំ​កំុ ស្រ្តី កេី កេា ឣាយុ",
    "«មួយ» «ពីរ ១២ 3 4",
    "គេមក។ គេទៅ ។ គេមិនមក។  ៗ េក ្រត",
)
TERM_RULES = (("the", "the"), ("and", "und"), ("of", "des"), ("khmer", "ខ្ញុំ"), ("mark", "!!"))
#: (key, flags, frequency, parts of speech)
LEXICON = (("ក", 1, 5, 1), ("ក", 4, 9, 2), ("ខ", 128, 0, 32), ("ខ", 1, 2, 32), ("គ", 64, 1, 0))

#: (key, authoritative, misspelling, frequency)
WORDS = tuple((w, True, False, n) for n, w in enumerate("ខ្ញុំ ទៅ ផ្សារ គាត់ មក គេ និយាយ ហើយ ពាក្យ ឆ្នាំ និង អក្សរ បញ្ចប់ មួយ ពីរ មិន".split()))
#: The rules of the surface, and one on the same spans as another.
TWICE = surface.RULES | {"terminology.mark": "[!?]{2,}"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _lined(docs: DataFrame, text) -> DataFrame:
    line = F.element_at(F.array(*(F.lit(x) for x in LINES)), (F.col("doc_id") % len(LINES) + 1).cast("int"))
    return docs.select("doc_id", F.concat(line, F.lit("\n"), text).alias("text"))


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(_docs(spark, sf_dir), F.substring("text", 1, 40))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(_docs(spark, sf_dir), F.col("text"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


DOCS_SQL = "(SELECT doc_id, text FROM documents)"
OVERLAY_SQL = f"(SELECT doc_id, list_extract([{', '.join(map(_quote, LINES))}], (doc_id % {len(LINES)} + 1)::INT) || chr(10) || substr(text, 1, 40) AS text FROM documents)"
WHOLE_SQL = OVERLAY_SQL.replace("substr(text, 1, 40)", "text")
_SUGGEST = "CASE WHEN rule_id = 'punct.repeated-khan' THEN '។' WHEN rule_id = 'punct.repeated-mark' THEN substr(original, length(original), 1) WHEN rule_id IN ('punct.space-before-lek-too', 'punct.double-lek-too') THEN 'ៗ' WHEN rule_id = 'punct.space-before-comma' THEN ',' WHEN rule_id = 'unicode.deprecated' THEN '។ល។' WHEN rule_id = 'unicode.zwsp-repeat' THEN chr(8203) WHEN rule_id = 'unicode.bidi-control' THEN '' END"
_SENTENCES = rf"""(
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1)::BIGINT AS sent, sentence, len(words)::BIGINT AS n_words, words FROM (
  SELECT doc_id, piece, trim(sentence, ' ') AS sentence, list_filter(string_split_regex(sentence, '[ \t]+'), lambda w: w <> '') AS words FROM (
    SELECT doc_id, unnest(range(len(g))) AS piece, unnest(g) AS sentence FROM (SELECT doc_id, string_split_regex(text, '{sentences.SENTENCE_END}') AS g FROM documents) AS a) AS b) AS c
WHERE len(words) > 0)"""

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql
    if sql and OVERLAY_SQL in sql:
        _QUERIES[f"{name}_whole"] = lambda spark, sf_dir: query(spark, sf_dir, _whole)
        _SQL[f"{name}_whole"] = sql.replace(OVERLAY_SQL, WHOLE_SQL)


def _one_rule(rule: str):
    rules = {rule: surface.RULES[rule]}
    return lambda spark, sf_dir, of=_overlay: surface.surface_findings(of(spark, sf_dir), rules)


for _rule in surface.RULES:
    _add("span_" + _rule.split(".")[1].replace("-", "_"), _one_rule(_rule), f"SELECT doc_id, rule_id, start, stop, original, {_SUGGEST} AS suggestion FROM ({spans.findings_sql(OVERLAY_SQL, {_rule: surface.RULES[_rule]})}) AS f")

_add("surface_findings", lambda s, d: surface.surface_findings(_docs(s, d)), f"SELECT doc_id, rule_id, start, stop, original, {_SUGGEST} AS suggestion FROM ({spans.findings_sql(DOCS_SQL, surface.RULES)}) AS f")
_add(
    "line_locator",
    lambda s, d: surface.located(_docs(s, d), {"punct.repeated-mark": surface.RULES["punct.repeated-mark"]}),
    f"SELECT doc_id, rule_id, start, (length(b) - length(replace(b, chr(10), '')) + 1)::BIGINT AS line, (length(list_extract(string_split(b, chr(10)), -1)) + 1)::BIGINT AS col FROM (SELECT *, substr(text, 1, start::INT) AS b FROM ({spans.findings_sql(DOCS_SQL, {'punct.repeated-mark': surface.RULES['punct.repeated-mark']})}) AS f) AS g",
)
_add(
    "quotes_unbalanced",
    lambda s, d, of=_overlay: surface.unbalanced_quotes(of(s, d)),
    f"""WITH q AS (SELECT doc_id, start, original, CASE original WHEN '«' THEN 1 ELSE -1 END AS step FROM ({spans.findings_sql(OVERLAY_SQL, {'quote': '[«»]'})}) AS f),
s AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY start) AS up, sum(-step) OVER (PARTITION BY doc_id ORDER BY start DESC) AS back FROM q),
m AS (SELECT *, coalesce(min(up) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
  coalesce(min(back) OVER (PARTITION BY doc_id ORDER BY start DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low_back FROM s)
SELECT doc_id, start, original FROM m WHERE (step = -1 AND up < least(low, 0)) OR (step = 1 AND back < least(low_back, 0))""",
)
_add(
    "digits_mixed",
    lambda s, d, of=_overlay: surface.mixed_digits(of(s, d)),
    f"""WITH f AS ({spans.findings_sql(OVERLAY_SQL, {'khmer': r'[\x{17E0}-\x{17E9}]+', 'arabic': '[0-9]+'})}),
c AS (SELECT *, count(*) FILTER (rule_id = 'khmer') OVER (PARTITION BY doc_id) AS k, count(*) FILTER (rule_id = 'arabic') OVER (PARTITION BY doc_id) AS a FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM c WHERE k > 0 AND a > 0 AND rule_id = CASE WHEN a <= k THEN 'arabic' ELSE 'khmer' END)
SELECT doc_id, start, original, rule_id AS system FROM r WHERE n <= 20""",
)
_add("digit_system", lambda s, d, of=_overlay: of(s, d).select("doc_id", chars.to_khmer_digits(F.col("text")).alias("khmer"), chars.to_arabic_digits(F.col("text")).alias("arabic")), f"SELECT doc_id, translate(text, '{chars.ARABIC_DIGITS}', '{chars.KHMER_DIGITS}') AS khmer, translate(text, '{chars.KHMER_DIGITS}', '{chars.ARABIC_DIGITS}') AS arabic FROM {OVERLAY_SQL} AS o")
_add("char_predicates", lambda s, d, of=_overlay: of(s, d).select("doc_id", *(chars.has(F.col("text"), k).alias(f"has_{k}") for k in chars.PREDICATES)), f"SELECT doc_id, {', '.join(f'regexp_matches(text, {_quote(p)}) AS has_{k}' for k, p in chars.PREDICATES.items())} FROM {OVERLAY_SQL} AS o")
_add("units", lambda s, d, of=_overlay: of(s, d).select("doc_id", F.size(normalize.units(F.col("text"))).cast("long").alias("n_units")), f"SELECT doc_id, len(regexp_extract_all(text, '{normalize.UNIT}'))::BIGINT AS n_units FROM {OVERLAY_SQL} AS o")
_add("cluster_split", lambda s, d, of=_overlay: of(s, d).select("doc_id", F.array_join(normalize.clusters(F.col("text")), "|").alias("clusters")), f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{normalize.CLUSTER}'), '|') AS clusters FROM {OVERLAY_SQL} AS o")
_add("orphan_marks", lambda s, d, of=_overlay: of(s, d).select("doc_id", F.size(F.filter(normalize.clusters(F.col("text")), lambda c: ~c.rlike(rf"\A{chars.BASE}"))).cast("long").alias("n_orphans")), f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '{normalize.CLUSTER}'), lambda c: NOT regexp_matches(c, '^{chars.BASE}')))::BIGINT AS n_orphans FROM {OVERLAY_SQL} AS o")
_add("cluster_normalize", lambda s, d, of=_whole: of(s, d).select("doc_id", F.array_join(F.transform(normalize.clusters(F.col("text")), normalize.normalize_cluster), "").alias("normal")))
_add("word_key", lambda s, d, of=_whole: of(s, d).select("doc_id", normalize.word_key(F.col("text")).alias("word_key")))
_add("fold_key", lambda s, d, of=_whole: of(s, d).select("doc_id", normalize.fold_key(F.col("text")).alias("fold_key")))
_add("sentence_split", lambda s, d: sentences.sentences(_docs(s, d)).select("doc_id", "sent", "sentence", "n_words"), f"SELECT doc_id, sent, sentence, n_words FROM {_SENTENCES} AS s")
_add("long_sentence", lambda s, d: sentences.long_sentences(_docs(s, d)), f"SELECT doc_id, sent, n_words FROM {_SENTENCES} AS s WHERE n_words > 40")
_add("adjacent_repeat", lambda s, d: sentences.adjacent_repeats(_docs(s, d)), f"SELECT doc_id, sent, word_at, words[word_at + 1] AS word FROM (SELECT *, unnest(range(1, len(words)))::BIGINT AS word_at FROM {_SENTENCES} AS s) AS t WHERE words[word_at + 1] = words[word_at]")
_add("sentence_repeat3", lambda s, d: sentences.third_uses(_docs(s, d)), f"SELECT doc_id, sent, word_at, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent, word ORDER BY word_at) AS n FROM (SELECT doc_id, sent, unnest(range(len(words)))::BIGINT AS word_at, unnest(words) AS word FROM {_SENTENCES} AS s WHERE n_words >= 10) AS t WHERE length(word) >= 4) AS u WHERE n = 3")
_add(
    "sentence_openings",
    lambda s, d: sentences.same_openings(_docs(s, d)),
    f"""WITH a AS (SELECT doc_id, sent, lower(words[1]) AS word FROM {_SENTENCES} AS s WHERE n_words >= 3),
b AS (SELECT *, CASE WHEN lag(word) OVER (PARTITION BY doc_id ORDER BY sent) = word THEN 0 ELSE 1 END AS fresh FROM a),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY sent) AS island FROM b)
SELECT doc_id, min(sent) AS first_sent, min(word) AS word, count(*) AS n FROM c GROUP BY doc_id, island HAVING count(*) >= 3""",
)
_add("doc_stats", lambda s, d: sentences.document_stats(_docs(s, d)), f"SELECT d.doc_id, length(text)::BIGINT AS n_characters, coalesce(w, 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_sentences FROM documents d LEFT JOIN (SELECT doc_id, sum(n_words) AS w, count(*) AS n FROM {_SENTENCES} AS s GROUP BY doc_id) AS x ON d.doc_id = x.doc_id")
_add("bigram_counts", lambda s, d: terms.bigram_counts(sentences.sentences(_docs(s, d))), f"SELECT a, b, count(*) AS n FROM (SELECT words[i] AS a, words[i + 1] AS b FROM (SELECT words, unnest(range(1, len(words))) AS i FROM {_SENTENCES} AS s) AS t) AS u GROUP BY a, b HAVING count(*) >= 3")
_add("user_term_rule", lambda s, d, of=_overlay: terms.term_hits(of(s, d), s.createDataFrame(TERM_RULES, "preferred string, variant string")), f"SELECT doc_id, preferred, variant, ((length(text) - length(replace(text, variant, ''))) // length(variant))::BIGINT AS n FROM {OVERLAY_SQL} AS o JOIN (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in TERM_RULES)}) AS r(preferred, variant) ON contains(text, variant)")
_add("lexicon_merge", lambda s, d: terms.merge_lexicon(s.createDataFrame(LEXICON, "key string, f int, n int, p int")), f"SELECT key, bit_or(f)::INT AS f, max(n)::INT AS n, bit_or(p)::INT AS p FROM (VALUES {', '.join(f'({_quote(k)}, {f}, {n}, {p})' for k, f, n, p in LEXICON)}) AS t(key, f, n, p) GROUP BY key")
_add("document_hash", lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256")), "SELECT doc_id, sha256(text) AS sha256 FROM documents")
_add("decisions_latest", lambda s, d: terms.latest_decisions(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", "ts"), ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) AS e WHERE n = 1")
_add("fixed_window_counter", lambda s, d: terms.fixed_windows(s.read.parquet(f"{d}/events.parquet")), "SELECT user_id, (floor(epoch(ts) / 60) * 60)::BIGINT AS window_start, count(*) AS n FROM events GROUP BY ALL")

_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(chunk, {_quote(rf'\A(?:{p})\z')}) THEN '{k}'" for k, p in tokens.KINDS.items()) + " END"
_add(
    "token_chunks",
    lambda s, d, of=_overlay: tokens.chunks(of(s, d)),
    f"SELECT doc_id, chunk_at, {_KIND_SQL} AS kind, (sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY chunk_at) - length(chunk))::BIGINT AS start, chunk FROM (SELECT doc_id, unnest(range(len(m)))::BIGINT AS chunk_at, unnest(m) AS chunk FROM (SELECT doc_id, regexp_extract_all(text, {_quote(tokens.CHUNK)}) AS m FROM {OVERLAY_SQL} AS o) AS p) AS q",
)
_add("word_segments", lambda s, d, of=_whole: tokens.segments(of(s, d), s.createDataFrame(WORDS, "key string, authoritative boolean, misspelling boolean, n int")))
_add("meaning_signature", lambda s, d, of=_whole: of(s, d).select("doc_id", meaning.meaning_signature(F.col("text")).alias("signature")))
_add("visual_order_repair", lambda s, d, of=_overlay: of(s, d).select("doc_id", meaning.repair_visual_order(F.col("text")).alias("text")), f"SELECT doc_id, regexp_replace(regexp_replace(text, {_quote(meaning.PREBASE)}, '\\1\\3\\2', 'g'), {_quote(meaning.RO_FIRST)}, '\\1\\3\\2\\4', 'g') AS text FROM {OVERLAY_SQL} AS o")
_add("visual_order_score", lambda s, d, of=_overlay: of(s, d).select("doc_id", F.round(meaning.visual_order_score(F.col("text")), 6).alias("score")), f"SELECT doc_id, round((len(regexp_extract_all(text, {_quote(meaning.PREBASE)})) + len(regexp_extract_all(text, {_quote(meaning.RO_FIRST)}))) / greatest(1.0, len(regexp_extract_all(text, '[\\x{{1780}}-\\x{{17FF}}]')) / 10), 6)::DOUBLE AS score FROM {OVERLAY_SQL} AS o")

_FOUND = f"(SELECT *, {_SUGGEST} AS suggestion FROM ({spans.findings_sql(DOCS_SQL, surface.RULES)}) AS ff)"
_LEVEL = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{v[0]}'" for r, v in surface.LEVELS.items()) + " ELSE 'suggestion' END"
_CONF = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {v[1]}" for r, v in surface.LEVELS.items()) + " ELSE 0.5 END"
_CELLS = [f"'\"' || regexp_replace(replace(coalesce(({c})::VARCHAR, ''), '\"', '\"\"'), '\\r?\\n', ' ', 'g') || '\"'" for c in ("doc_id", "start", "stop", "original", "split_part(rule_id, '.', 1)", _LEVEL, "suggestion", "rule_id")]
_add(
    "one_finding_per_span",
    lambda s, d: findings.one_per_span(surface.surface_findings(_docs(s, d), TWICE)),
    f"""WITH f AS (SELECT *, coalesce(nullif(coalesce(list_position(['unicode', 'punct', 'terminology', 'legal'], split_part(rule_id, '.', 1)), 0), 0), 99) AS layer, {_CONF} AS conf FROM ({spans.findings_sql(DOCS_SQL, TWICE)}) AS x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, stop ORDER BY layer, conf DESC, rule_id) AS n FROM f)
SELECT doc_id, start, stop, max(rule_id) FILTER (n = 1) AS rule_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (n > 1), '') AS also_flagged_by FROM r GROUP BY doc_id, start, stop""",
)
_add(
    "numbered_findings",
    lambda s, d: findings.numbered(_docs(s, d), surface.RULES),
    f"""SELECT doc_id, 'F' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS finding_id, rule_id, start, stop, substr(text, greatest(start - 40, 0) + 1, stop + 40 - greatest(start - 40, 0)) AS context, (start - greatest(start - 40, 0))::BIGINT AS context_offset
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rule_id) AS n FROM {_FOUND} AS f) AS g""",
)
_FIXES = {r: surface.RULES[r] for r in ("punct.repeated-mark", "punct.space-before-comma")}
_add("corrected_text", lambda s, d: findings.corrected(_docs(s, d), surface.surface_findings(_docs(s, d), _FIXES)), r"SELECT doc_id, regexp_replace(regexp_replace(text, '[!?]+([!?])', '\1', 'g'), '[ \t]+,', ',', 'g') AS text FROM documents")
_add("findings_by_document", lambda s, d: findings.by_document(_docs(s, d), surface.surface_findings(_docs(s, d))), "SELECT d.doc_id, " + ", ".join(f"count(*) FILTER (level = '{x}') AS n_{x}" for x in ("error", "warning", "suggestion")) + f" FROM documents d LEFT JOIN (SELECT doc_id, {_LEVEL} AS level FROM {_FOUND} AS f) AS g ON d.doc_id = g.doc_id GROUP BY d.doc_id")
_add("findings_by_category", lambda s, d: findings.by_category(surface.surface_findings(_docs(s, d))), f"SELECT category, severity, count(*) AS n FROM (SELECT split_part(rule_id, '.', 1) AS category, {_LEVEL} AS severity FROM {_FOUND} AS f) AS g GROUP BY ROLLUP (category, severity)")
_add("csv_report", lambda s, d: findings.csv_rows(surface.surface_findings(_docs(s, d))), f"SELECT doc_id, start, rule_id, {' || chr(44) || '.join(_CELLS)} AS csv_row FROM {_FOUND} AS f")
_add("html_report", lambda s, d: findings.html_lists(surface.surface_findings(_docs(s, d))), f"SELECT doc_id, '<ul>' || string_agg('<li>' || rule_id || ' <mark>' || replace(replace(replace(replace(original, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</mark></li>', '' ORDER BY start, rule_id) || '</ul>' AS html FROM {_FOUND} AS f GROUP BY doc_id")
_add("nth_occurrence", lambda s, d: findings.nth_occurrence(_docs(s, d), "the", 2), "SELECT doc_id, length(array_to_string(g[1:2], 'the'))::BIGINT AS start, (length(array_to_string(g[1:2], 'the')) + 3)::BIGINT AS stop FROM (SELECT doc_id, string_split(text, 'the') AS g FROM documents) AS p WHERE len(g) > 2")
_add(
    "span_agreement",
    lambda s, d: findings.agreement(surface.surface_findings(_docs(s, d), _FIXES), surface.surface_findings(_docs(s, d), {"mark": "[!?]+"})),
    f"""WITH a AS ({spans.findings_sql(DOCS_SQL, _FIXES)}), f AS ({spans.findings_sql(DOCS_SQL, {'mark': '[!?]+'})})
SELECT (SELECT count(*) FROM a) AS n_expected, (SELECT count(*) FROM a WHERE EXISTS (SELECT 1 FROM f WHERE f.doc_id = a.doc_id AND f.start < a.stop AND f.stop > a.start)) AS n_hit,
(SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE f.doc_id = a.doc_id AND f.start < a.stop AND f.stop > a.start)) AS n_false""",
)
_BLANKS = f"({', '.join(f'chr({ord(x)})' for x in findings.BLANKS)}, '')"
_add("multiple_spaces", lambda s, d, of=_overlay: findings.wide_gaps(of(s, d)), f"SELECT doc_id, start, stop FROM ({spans.findings_sql(OVERLAY_SQL, {'gap': ' {2,}'})}) AS f WHERE start > 0 AND substr(text, start, 1) NOT IN {_BLANKS} AND substr(text, stop + 1, 1) NOT IN {_BLANKS}")
_SPACED = {"spaced": r"[\x{1780}-\x{17DD}] \x{17D4}", "tight": r"[\x{1780}-\x{17DD}]\x{17D4}"}
_add("spaced_khan", lambda s, d, of=_overlay: findings.spaced_khan(of(s, d)), f"SELECT doc_id, start + 1 AS start, stop FROM (SELECT *, count(*) FILTER (rule_id = 'spaced') OVER (PARTITION BY doc_id) AS a, count(*) FILTER (rule_id = 'tight') OVER (PARTITION BY doc_id) AS b FROM ({spans.findings_sql(OVERLAY_SQL, _SPACED)}) AS f) AS g WHERE rule_id = 'spaced' AND a < b")
_add("legacy_font", lambda s, d: findings.legacy_font(_docs(s, d)), r"SELECT doc_id FROM documents WHERE length(text) > 40 AND regexp_matches(text, '[A-Za-z\[\];''\\]{25,}') AND NOT regexp_matches(text, '[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]')")


#: Lines that the dictionary-based rules have something to say about, by doc_id, before the whole document.
RULE_LINES = (
    "ខ្ញុំនិងទៅផ្សារ។ ខ្ញុំទៅទៅ។ ខ្ងុំទៅសាលារៀន។",
    "ម្សិលមិញស្អែកខ្ញុំទៅ។ គាត់មកមិនមក។ សាលារៀនធំតូច.",
    "តើអ្នកទៅផ្សារ។ ឃើញ: ក។ខ ៗ មានសិស្ស ២០ មក។",
    "គាត់មិនត្រឹមតែរៀនពូកែ។ ខ្ញុំអត់ដឹងទេ។ ខ្ញុំទៅផ្សារ។ ខ្ញុំមកសាលារៀន។",
    "សេចក្ដីល្អ សេចក្តី។ ហៅថា «ភាគីមួយ» «ភាគិមួយ»។ គេទៅ។",
    "សមត្តភាពរបស់គាត់ល្អ។ លោក ឡុងវីន បានមក។ គាត់អោយខ្ញុំ។",
    "ខ្ញុំទៅដែល។ សៀវភៅដែរខ្ញុំទិញ។ ខ្ញុំសាលារៀនទៅ។ គាត់ពិនិត្សឯកសារ។",
)
#: (key, flags, frequency, parts of speech)
RULE_LEXICON = tuple(
    (word, flags, n, lex.POS.get(pos, 0))
    for pos, flags, n, group in (
        ("PRON", 1, 50, "ខ្ញុំ គាត់ អ្នក គេ លោក"), ("V", 1, 30, "ទៅ មក ទិញ រៀន ដឹង មាន ពិនិត្យ ឱ្យ"), ("N", 1, 9, "សាលារៀន ផ្សារ សៀវភៅ សិស្ស ឯកសារ សមត្ថភាព សេចក្ដី"),
        ("CONJ", 1, 90, "និង"), ("PART", 1, 90, "នឹង ដែល ដែរ មិន តើ ទេ បាន មិនត្រឹមតែ"), ("ADJ", 1, 9, "ធំ តូច ល្អ ពូកែ"), ("ADV", 1, 5, "ម្សិលមិញ ស្អែក"), ("PREP", 1, 50, "របស់"),
        ("N", 4, 1, "ភាព"), ("", 4, 0, "សមត្ត"), ("N", 2, 9, "សេចក្តី"), ("", 1024, 3, "អត់"), ("", 512, 0, "អោយ"),
    )
    for word in group.split()
)
WRONG = ({"wrong": "អោយ", "correct": "ឱ្យ", "confidence": 0.85},)
STYLE = ({"rule_id": "style.phrase", "pattern": "អត់ដឹង", "suggestions": ["មិនដឹង"], "severity": "suggestion", "confidence": 0.4, "category": "wording"},)
LAW_WORDS = (("ភាគីមួយ", "ភាគិមួយ"), ("the", "and"))


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, RULE_LINES)), (F.col("doc_id") % len(RULE_LINES) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.concat(line, F.lit("\n"), F.col("text")).alias("text"))


def _rule_lexicon(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(RULE_LEXICON, "key string, f int, n int, p int")
    return lex.with_inherited_pos(rows.withColumn("key", normalize.word_key(F.col("key"))))


def _analysed(spark: SparkSession, sf_dir: str, phrases: tuple = ()) -> tuple[DataFrame, DataFrame]:
    table = _rule_lexicon(spark)
    return words.analysed(_ruled(spark, sf_dir), table, list(phrases)), table


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("suggestions", F.array_join("suggestions", "|"))


def _style(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _analysed(spark, sf_dir, ("មិនត្រឹមតែ", *(r["pattern"] for r in STYLE), *rules.VAGUE))
    vague = [{"rule_id": "legal.vague-term", "suggestions": None, "severity": "info", "confidence": 0.5} for _ in rules.VAGUE]
    hits = [rules.correlatives({"មិនត្រឹមតែ": 0}), rules.phrase_hits(1, list(STYLE), rules.cut_keeps_sentence), rules.phrase_hits(1 + len(STYLE), vague), rules.register_hits([{"informal": "អត់", "suggestions": ["មិន"]}], True), rules.unclear_actor(), rules.first_person(), rules.question_marks()]
    return _flat(rules.found(s, *hits))


def _spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, table = _analysed(spark, sf_dir, tuple(w["wrong"] for w in WRONG))
    return _flat(spelling.spelling(s, table, words.bigrams(s), list(WRONG), strict=True))


def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ruled(spark, sf_dir)
    s, table = _analysed(spark, sf_dir)
    found = consistency.variant_mix(s, lex.variant_groups(table)).unionByName(consistency.defined_terms(docs)).unionByName(consistency.synonym_mix(docs, list(LAW_WORDS)))
    return _flat(found.unionByName(consistency.user_rules(docs, [("ការ", "ទៅ")])))


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, table = _analysed(spark, sf_dir)
    found = rules.grammar(s, "legal").unionByName(rules.meaning(s, table))
    placed = review.ordered(review.legal_guard(review.record(found)), _ruled(spark, sf_dir), s)
    none = spark.createDataFrame([], "doc_id long, finding_id string, status string, chosen string, at int")
    return review.csv_lines(review.fields(review.decided(placed, none)))


def _corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon rows of the corpus: the words of each language are a source of their own, n their greatest count in a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flag = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 4).when(F.col("lang") == "fr", 8).otherwise(2)
    one = docs.select("doc_id", flag.alias("f"), F.explode(F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")).alias("key"))
    return one.groupBy("doc_id", "key").agg(F.max("f").alias("f"), F.count("*").cast("int").alias("n")).select("key", "f", "n", F.lit(0).alias("p"))


_CORPUS_SQL = """(SELECT key, bit_or(f)::INT AS f, max(n)::INT AS n FROM (SELECT doc_id, key, max(f) AS f, count(*)::INT AS n FROM
(SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 4 WHEN 'fr' THEN 8 ELSE 2 END AS f, unnest(string_split_regex(text, '[ \n]+')) AS key FROM documents) AS a WHERE key <> '' GROUP BY doc_id, key) AS b GROUP BY key)"""

_add("context_punctuation", lambda s, d: punctuation.context_findings(_ruled(s, d)))
_add("analysed_sentences", lambda s, d: _analysed(s, d)[0].select("doc_id", "sent", "start", "stop", "terminator", F.size("words").alias("n_words"), F.array_join(F.transform("words", lambda w: w["key"]), " ").alias("keys")))
_add("grammar_rules", lambda s, d: _flat(rules.grammar(_analysed(s, d)[0], "legal")))
_add("meaning_rules", lambda s, d: _flat(rules.meaning(*_analysed(s, d))))
_add("opening_runs", lambda s, d: _flat(rules.openings(_analysed(s, d)[0])))
_add("style_rules", _style)
_add("spelling_rules", _spelling)
_add("consistency_rules", _consistency)
_add("review_csv", _review)
_add("corpus_lexicon", lambda s, d: lex.merged(_corpus_words(s, d)).select("key", "f", "n"), f"SELECT * FROM {_CORPUS_SQL} AS c")
_add(
    "lexicon_lookups",
    lambda s, d: lex.merged(_corpus_words(s, d)).select("key", lex.known(F.col("f")).alias("known"), lex.weak(F.col("f"), F.col("n")).alias("weak"), lex.source_rank(F.col("f")).alias("rank"), lex.primary_source(F.col("f")).alias("source")),
    f"SELECT key, TRUE AS known, (f & {lex.AUTHORITATIVE}) = 0 AND n < 3 AS weak, CASE WHEN f & 1 > 0 THEN 2 WHEN f & 8 > 0 THEN 4 WHEN f & 2 > 0 THEN 7 ELSE 9 END AS rank, CASE WHEN f & 1 > 0 THEN 'headword' WHEN f & 8 > 0 THEN 'modern' WHEN f & 2 > 0 THEN 'attested' ELSE 'wordlist' END AS source FROM {_CORPUS_SQL} AS c",
)
_add(
    "lexicon_compounds",
    lambda s, d: lex.with_inherited_pos(lex.merged(_corpus_words(s, d)).withColumn("p", F.when(F.length("key") == 3, 1).when(F.length("key") == 4, 2).otherwise(0))).select("key", "p"),
    f"""WITH l AS (SELECT key, f, CASE length(key) WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS p FROM {_CORPUS_SQL} AS c),
c AS (SELECT key, unnest(range(2, length(key)::INT)) AS cut FROM l WHERE p = 0 AND length(key) > 2),
m AS (SELECT c.key, arg_max(h.p, c.cut) AS q FROM c JOIN l AS h ON h.key = substr(c.key, 1, c.cut::INT) AND h.p <> 0 AND (h.f & {lex.AUTHORITATIVE}) <> 0 JOIN l AS t ON t.key = substr(c.key, c.cut::INT + 1) GROUP BY c.key)
SELECT l.key, CASE WHEN l.p <> 0 THEN l.p ELSE coalesce(m.q, 0) END AS p FROM l LEFT JOIN m ON m.key = l.key""",
)
_add(
    "swapped_words",
    lambda s, d: evaluation.swapped(_ruled(s, d)).select("doc_id", "kind", "start", F.length("text").cast("long").alias("n")),
    "SELECT doc_id, a || '>' || b AS kind, (strpos(text, a) - 1)::BIGINT AS start, (length(text) - length(a) + length(b))::BIGINT AS n FROM (SELECT doc_id, list_extract([" + ", ".join(map(_quote, RULE_LINES)) + f"], (doc_id % {len(RULE_LINES)} + 1)::INT) || chr(10) || text AS text FROM documents) AS t, (VALUES " + ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in evaluation.REAL_WORDS) + ") AS v(a, b) WHERE strpos(text, a) > 0",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface findings with their lines over all documents."""
    return surface.located(_docs(spark, sf_dir))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
