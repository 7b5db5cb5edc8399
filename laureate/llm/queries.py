"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, merkle, mixing, personal, quality, repetition, simhash, suffix_dedup, token_rollup, topk, toxicity, url_filter, whitening
from .common import WORD, read

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

RULES = tuple(
    url_filter.parse_rule(v, r)
    for v, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
)

#: The operator's own rules, for urls that no rule fits: paths of lists, feeds and files.
GLOBS = ("*\n*/tag/*", "*\n*/feed", "*\n*/login*", "*\n*.zip", "*\n*.exe", "*\n*/cart/*", "ads.*\n*", "*.ads.*\n*")

#: CRC-32 of doc_id in decimal before its bits are turned round, so odd where the checksum is even: eight shifts for each character.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"""

#: Words that hold a letter or digit.
REAL_WORD = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches: all documents under the byte-level BPE and as words, revised word counts (signs alone no
    longer count), deletion of the documents labelled as poor, and the first batch once more."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    count = lambda pattern: F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0))
    poor = docs.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    rollup = token_rollup.TokenRollup(spark)
    load = token_rollup.changes_of(bpe.counted(docs, VOCABULARY, public_tokenizers.PATTERN), "insert", "byte_bpe_multi_50k", F.col("n_tokens"))
    rollup.commit("load", load)
    rollup.commit("words", token_rollup.changes_of(docs, "insert", "words", count(WORD)))
    rollup.commit("revision", token_rollup.changes_of(docs, "revise", "words", count(REAL_WORD)))
    gone = [token_rollup.changes_of(poor, "delete", t, F.lit(0)) for t in ("words", "byte_bpe_multi_50k")]
    rollup.commit("poor", gone[0].unionByName(gone[1]))
    rollup.commit("load", load)
    return rollup.totals.select("source", "lang", "tokenizer", "n_docs", "n_tokens")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, digest=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(read(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_digest(read(spark, sf_dir, "documents"), length=200)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), RULES, GLOBS)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), most=8)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_counts, op2_bpe, op3_simhash, op4_suffix_dedup, op5_topk, op6_url_filter, op7_source_mix, op8_quality, op9_toxicity, op10_repetition, op11_whitening, op12_merkle,
        op13_personal,
    )
    return {f.__name__: f for f in own}


_COUNT = "len(regexp_extract_all(coalesce(text, ''), '{}'))"


#: White space of the pattern, for an engine whose `\\s` is ASCII's.
_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _coded() -> str:
    """Common tables of SQL: `split` (doc_id, row, pieces) of documents and `coded` (piece, ids). The engine has no look-ahead:
    U+E000, which the tables do not hold, marks the last white space before other characters, so that a run of blanks ends there."""
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}\x{{E000}}]+|[{_SPACE}]+".replace("'", "''")
    return rf"""
  vocabulary AS MATERIALIZED (SELECT hex(from_base64(t)) AS h, id FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'id': 'INT'}})),
  merges AS MATERIALIZED (SELECT l.id AS a, r.id AS b, t.id AS r FROM (SELECT *, unnest(range(2, len(h), 2)) AS i FROM vocabulary) t
    JOIN vocabulary l ON l.h = substr(t.h, 1, t.i) JOIN vocabulary r ON r.h = substr(t.h, t.i + 1)),
  split AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{_SPACE}])([^{_SPACE}])', chr(57344) || '\1\2', 'g'), '{pattern}') AS pieces FROM documents),
  piece AS MATERIALIZED (SELECT piece, hex(encode(piece)) AS h, row_number() OVER () AS n FROM (SELECT DISTINCT unnest(pieces) AS piece FROM split)),
  begun AS MATERIALIZED (SELECT n, [id] AS ids FROM piece JOIN vocabulary USING (h)
    UNION ALL SELECT n, list(id ORDER BY i) FROM (SELECT n, i, substr(h, i, 2) AS h FROM (SELECT n, h, unnest(range(1, len(h), 2)) AS i FROM piece ANTI JOIN vocabulary USING (h))) JOIN vocabulary USING (h) GROUP BY n),
  walk(n, ids, live) AS (SELECT n, ids, true FROM begun
    UNION ALL SELECT t.n, CASE WHEN k IS NULL THEN ids ELSE ids[:(k % 4294967296)] || [(k // 4294967296)::INT] || ids[(k % 4294967296) + 3:] END, k IS NOT NULL
    FROM walk t LEFT JOIN (SELECT n, min(m.r::BIGINT * 4294967296 + p) AS k FROM (SELECT n, unnest(ids) AS a, unnest(ids[2:]) AS b, unnest(range(len(ids) - 1)) AS p FROM walk WHERE live) x
      JOIN merges m USING (a, b) GROUP BY n) best USING (n)
    WHERE live),
  coded AS MATERIALIZED (SELECT piece, ids FROM walk JOIN piece USING (n) WHERE NOT live)"""


#: The five primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _hashed(seed: int = 42) -> str:
    """Common tables of SQL: `hashes` (s, h) of the strings `strings` (s), h their XXH64. Numbers are 128 bits wide and cut to 64 after each product. All steps of the
    hash have one form: h becomes turned(h xor v, r) * m + a."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _PRIMES)
    cut = lambda x: f"(({x}) & 18446744073709551615::UHUGEINT)"
    turned = lambda x, r: f"({cut(f'({x}) << {r}::UHUGEINT')} | (({x}) >> (64 - {r})::UHUGEINT))"
    step = lambda v, r, m, a: f"{{'v': {v}, 'r': {r}::UHUGEINT, 'm': {m}, 'a': {a}}}"
    number = lambda at, n: "(" + " + ".join(f"(instr('0123456789ABCDEF', substr(x, 2 * ({at}) + {2 * i + 1}, 1)) * 16 + instr('0123456789ABCDEF', substr(x, 2 * ({at}) + {2 * i + 2}, 1)) - 17)::UHUGEINT * {256**i}::UHUGEINT" for i in range(n)) + ")"
    own = lambda v: cut(f"{turned(cut(f'({v}) * {p2}'), 31)} * {p1}")
    start = (seed + _PRIMES[0] + _PRIMES[1], seed + _PRIMES[1], seed, seed - _PRIMES[0])
    lane = lambda i: f"list_reduce(list_prepend({start[i] % 2**64}::UHUGEINT, [l[j] FOR j IN range({i + 1}, n // 32 * 4 + 1, 4)]), lambda c, v: {cut(turned(cut(f'c + {cut(f"v * {p2}")}'), 31) + f' * {p1}')})"
    return f"""
  hexed AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM strings),
  laned AS (SELECT *, [{number('8 * j', 8)} FOR j IN range(n // 8)] AS l FROM hexed),
  striped AS (SELECT *, CASE WHEN n >= 32 THEN [{', '.join(map(lane, range(4)))}] END AS c FROM laned),
  steps AS (SELECT s, CASE WHEN n >= 32 THEN {cut(' + '.join(turned(f'c[{i + 1}]', r) for i, r in enumerate((1, 7, 12, 18))))} ELSE {seed + _PRIMES[4]}::UHUGEINT END AS h,
    CASE WHEN n >= 32 THEN [{step(own('v'), 0, p1, p4)} FOR v IN c] ELSE [] END || [{step('0::UHUGEINT', 0, '1::UHUGEINT', 'n::UHUGEINT')}]
    || [{step(own('l[j]'), 27, p1, p4)} FOR j IN range(n // 32 * 4 + 1, n // 8 + 1)]
    || CASE WHEN n % 8 >= 4 THEN [{step(cut(f"{number('n // 8 * 8', 4)} * {p1}"), 23, p2, p3)}] ELSE [] END
    || [{step(cut(f"{number('j', 1)} * {p5}"), 11, p1, '0::UHUGEINT')} FOR j IN range(n // 4 * 4, n)] AS t FROM striped),
  walked AS (SELECT s, list_reduce(list_prepend({step('h', 0, '0::UHUGEINT', '0::UHUGEINT')}, t), lambda g, y: {{'v': {cut(f"{turned('xor(g.v, y.v)', 'y.r')} * y.m + y.a")}, 'r': y.r, 'm': y.m, 'a': y.a}}).v AS h FROM steps),
  hashes AS (SELECT s, xor(h, h >> 32::UHUGEINT) AS h FROM (SELECT s, {cut(f'xor(h, h >> 29::UHUGEINT) * {p3}')} AS h FROM (SELECT s, {cut(f'xor(h, h >> 33::UHUGEINT) * {p2}')} AS h FROM walked)))"""


def oracle_sql() -> dict[str, str]:
    sql = {}
    sql["op1_token_counts"] = f"""
WITH RECURSIVE {_coded()},
  tokens AS (SELECT row, sum(len(ids)) AS n FROM (SELECT row, unnest(pieces) AS piece FROM split) JOIN coded USING (piece) GROUP BY row),
  numbered AS (SELECT *, row_number() OVER () AS row FROM documents),
  counts AS (SELECT doc_id, source, lang, 'byte_bpe_multi_50k' AS tokenizer, coalesce(n, 0) AS n FROM numbered LEFT JOIN tokens USING (row) WHERE doc_id IS NOT NULL
    UNION ALL SELECT doc_id, source, lang, 'words', {_COUNT.format(REAL_WORD)} FROM documents WHERE doc_id IS NOT NULL),
  once AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY doc_id, tokenizer ORDER BY n DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1),
  poor AS (SELECT DISTINCT doc_id, true AS gone FROM labels WHERE quality = 0)
SELECT source, lang, tokenizer, count(*) FILTER (gone IS NULL) AS n_docs, coalesce(sum(n) FILTER (gone IS NULL), 0)::BIGINT AS n_tokens FROM once LEFT JOIN poor USING (doc_id) GROUP BY ALL
"""
    sql["op2_bpe"] = f"""
WITH RECURSIVE {_coded()},
  decoded AS (SELECT piece, any_value(ids) AS ids, string_agg(h, '' ORDER BY i) AS h FROM (SELECT piece, ids, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM coded) JOIN vocabulary USING (id) GROUP BY piece),
  texts AS (SELECT row, sum(len(ids)) AS n, string_agg(array_to_string(ids, ','), ',' ORDER BY p) AS decimal, string_agg(h, '' ORDER BY p) AS h
    FROM (SELECT row, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM split) JOIN decoded USING (piece) GROUP BY row)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, sha256(coalesce(decimal, '')) AS ids_sha256, sha256(unhex(coalesce(h, ''))) AS decoded_sha256 FROM split LEFT JOIN texts USING (row)
"""
    votes = ", ".join(f"sum(((h >> {b}) & 1::UBIGINT)::INT) AS b{b}" for b in range(simhash.BITS))
    bits = " | ".join(f"(CASE WHEN 2 * b{b} > n THEN {1 << b} ELSE 0 END)::UBIGINT" for b in range(simhash.BITS))
    sql["op3_simhash"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
  shingled AS MATERIALIZED (SELECT row, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM d),
  strings AS (SELECT DISTINCT s FROM shingled), {_hashed()},
  counted AS (SELECT row, count(*) AS n, {votes} FROM (SELECT row, h::UBIGINT AS h FROM shingled JOIN hashes USING (s)) GROUP BY row),
  prints AS MATERIALIZED (SELECT row, doc_id, coalesce({bits}, 0::UBIGINT) AS fp FROM d LEFT JOIN counted USING (row)),
  own AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM prints GROUP BY fp),
  links AS MATERIALIZED (SELECT a.fp AS u, b.fp AS v FROM own a JOIN own b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
  reached(u, v) AS (SELECT fp, fp FROM own UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
  least AS (SELECT r.u AS fp, min(o.low) AS component_id FROM reached r JOIN own o ON o.fp = r.v GROUP BY r.u)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN least USING (fp)
"""
    sql["op4_suffix_dedup"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h FROM documents),
  blocks AS (SELECT row, b, substr(h, 2 * b + 1, 2 * (128 + 199)) AS h FROM (SELECT row, h, unnest(range(0, len(h) // 2 - 199, 128)) AS b FROM d)),
  windows AS (SELECT row, b + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT row, b, h, unnest(range(len(h) // 2 - 199)) AS i FROM blocks)),
  starts AS (SELECT row, i FROM windows SEMI JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
  runs AS (SELECT row, min(i) AS s, max(i) + 200 AS e FROM (SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS run FROM
    (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM starts)) GROUP BY row, run),
  spans AS (SELECT row, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e FROM runs GROUP BY row)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(s) + 2), lambda k: substr(h, 2 * coalesce(e[k - 1], 0) + 1, 2 * (coalesce(s[k], len(h) // 2) - coalesce(e[k - 1], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (row)
"""
    sql["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
    fits = "\n".join(
        f"UNION ALL SELECT page_id, '{r.text}', '{r.verdict}' FROM parts WHERE (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        for r in RULES
    )
    blocks = " OR ".join("(host || chr(10) || path) GLOB ('" + g.replace("\n", "' || chr(10) || '") + "')" for g in GLOBS)
    sql["op6_url_filter"] = f"""
WITH parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path FROM pages),
     fits AS (SELECT NULL::BIGINT AS page_id, '' AS rule, '' AS verdict WHERE false {fits}),
     best AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, CASE WHEN b.rule IS NOT NULL THEN b.verdict WHEN host <> '' AND ({blocks}) THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""
    sql["op7_source_mix"] = f"""
WITH d AS (SELECT doc_id, source, text, {_COUNT.format(WORD)}::BIGINT AS size FROM documents),
     per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
     w AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
     l AS (SELECT *, row_number() OVER o AS nth,
                  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
           FROM w WINDOW o AS (ORDER BY cap / weight, n)),
     f AS (SELECT min(nth) AS nth FROM l WHERE cap > level * weight),
     t AS (SELECT l.source, l.source_size, CASE WHEN f.nth IS NULL OR l.cap <= l.level * l.weight THEN l.cap ELSE (SELECT level FROM l x WHERE x.nth = f.nth) * l.weight END AS target FROM l, f)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (floor(coalesce(target / nullif(source_size, 0), 0)) + CASE WHEN ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'text:' || md5(d.text), '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE
                        < coalesce(target / nullif(source_size, 0), 0) - floor(coalesce(target / nullif(source_size, 0), 0)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
    grams = "\n".join(
        f"""UNION ALL SELECT row, sum(chars) / any_value(total) / {limit}::DOUBLE FROM (SELECT DISTINCT row, total, unnest(range(i, i + {n})) AS j FROM
    (SELECT row, total, i, row_number() OVER (PARTITION BY row, gram ORDER BY i) AS nth FROM (SELECT row, total, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM
    (SELECT row, total, list_transform(range(1, len(w) - {n - 2}), lambda i: md5(array_to_string(w[i:i + {n - 1}], ' '))) AS grams FROM d))) WHERE nth > 1) JOIN words USING (row, j) GROUP BY row"""
        for n, limit in repetition.LIMITS.items()
    )
    sql["op10_repetition"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, len(array_to_string(w, ''))::DOUBLE AS total FROM documents),
  words AS (SELECT row, generate_subscripts(w, 1) AS j, len(unnest(w))::DOUBLE AS chars FROM d),
  lines AS (SELECT row, total, line, len(array_to_string(regexp_extract_all(line, '{WORD}'), ''))::DOUBLE AS chars, row_number() OVER (PARTITION BY row, line) AS nth
    FROM (SELECT row, total, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
  again AS (SELECT row, count(*) AS n, sum(chars) / any_value(total) / {repetition.LINE_LIMIT}::DOUBLE AS worst FROM lines WHERE nth > 1 GROUP BY row),
  eight AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS j FROM
    (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS m FROM (SELECT row, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM
    (SELECT row, list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' '))) AS grams FROM d))) WHERE m > 1) GROUP BY row),
  worst AS (SELECT row, max(worst) AS worst FROM (SELECT row, worst FROM again {grams}) GROUP BY row),
  base AS (SELECT doc_id, len(w) AS n_words, total::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines, coalesce(eight.n, 0) AS n_repeat_words,
    coalesce(worst.worst, 0) AS repetition FROM d LEFT JOIN again USING (row) LEFT JOIN eight USING (row) LEFT JOIN worst USING (row))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND repetition <= 1 AS kept FROM base
"""
    framed = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(framed(c) for c in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"
    grow = "SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {} WHERE n > 1 GROUP BY g, lvl, pos // 3, n"
    steps = """SELECT b.row, {at} + n.lvl AS step, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < b.pos // 3 ** n.lvl), '') AS l, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > b.pos // 3 ** n.lvl), '') AS r
    FROM {of} b JOIN {tree} n ON n.g IS NOT DISTINCT FROM b.g AND n.n > 1 AND n.pos // 3 = b.pos // 3 ** (n.lvl + 1) GROUP BY b.row, n.lvl"""
    whole = lambda text: text.replace("3 ** (n.lvl + 1)", "(3 ** (n.lvl + 1))::BIGINT").replace("3 ** n.lvl)", "(3 ** n.lvl)::BIGINT)")
    sql["op12_merkle"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 1 AND contains(text, chr(10)) THEN {leaf("replace(text, chr(10), '')")} END AS other FROM documents),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
  tree(g, lvl, pos, h, n) AS (SELECT g, 0::BIGINT, pos, leaf, n FROM leaves UNION ALL {grow.format('tree')}),
  subroots AS (SELECT g AS source, h AS subroot, lvl AS height, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
  top(g, lvl, pos, h, n) AS (SELECT 0, 0::BIGINT, pos, subroot, n FROM subroots UNION ALL {grow.format('top')}),
  placed AS (SELECT row, 0 AS g, s.pos, height FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM g),
  steps AS ({whole(steps.format(at='0', of='leaves', tree='tree'))} UNION ALL {whole(steps.format(at='any_value(b.height)', of='placed', tree='top'))}),
  walk(row, step, h) AS (SELECT row, 0::BIGINT, coalesce(other, leaf) FROM leaves UNION ALL SELECT w.row, w.step + 1, sha256(l || h || r) FROM walk w JOIN steps s ON s.row = w.row AND s.step = w.step),
  folded AS (SELECT row, arg_max(h, step) AS folded_root FROM walk GROUP BY row),
  proofs AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY row)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM g JOIN folded USING (row) LEFT JOIN proofs USING (row), (SELECT h AS root FROM top WHERE n = 1)
"""
    return sql
