"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import (
    byte_bpe, conversation_repair, decision_list, language, licences, near_duplicates, parity_join, secret_ledger, sentence_spans, sharding, templates, vector_codes, warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"), shards=8)


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(_table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "mixture")


def op4_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus comes in two loads: even ids under earlier rules, then all of it against the ledger of the first."""
    docs = _table(spark, folder, "documents")
    _, ledger = secret_ledger.scan_documents(docs.filter("doc_id % 2 = 0"), rules=secret_ledger.EARLIER)
    findings, _ = secret_ledger.scan_documents(docs, ledger)
    return secret_ledger.summary(findings)


def op6_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.repeated(_table(spark, folder, "documents"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), width=2, percent=80)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, folder, "pages")))


def op10_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    found = decision_list.judged_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", *decision_list.BASE, "base_failed", "rule", "kept")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encoded(_table(spark, folder, "embeddings"))


def op12_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.joined(_table(spark, folder, "documents"), width=3, percent=90)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_licences, op3_language, op4_templates, op5_secrets, op6_sentence_spans, op7_byte_bpe, op8_near_duplicates,
        op9_warc, op10_decision_list, op11_vector_codes, op12_parity_join, op13_conversation_repair,
    )
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licence_sql() -> str:
    """The same cuts, look-ups and rules; one step per rule."""
    marked = "coalesce(text, '')"
    for pattern, by in licences.BREAKS:
        put = " || ".join(_text(x) if x != licences.MARK else "chr(1)" for x in by.partition(licences.MARK) if x)
        marked = f"regexp_replace({marked}, {_text(pattern)}, {put}, 'g')"
    low = lambda x: f"translate({x}, '{licences.UPPER}', '{licences.LOWER}')"
    plain = f"trim(regexp_replace({low('s')}, '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(f"{_text(w)}: {_text(name)}" for name, wordings in licences.SENTENCES.items() for w in wordings)
    steps, last = [], "r0"
    for i, (name, sequence) in enumerate(licences.RULES, 1):
        part = _text("|" + "||".join(sequence) + "|")
        found = f"CASE WHEN contains(rest, {part}) AND NOT list_contains(found, {_text(name)}) THEN list_append(found, {_text(name)}) ELSE found END"
        steps.append(f"r{i} AS (SELECT doc_id, cues, ids, {found} AS found, replace(rest, {part}, '|-|') AS rest FROM {last})")
        last = f"r{i}"
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN regexp_matches({low("coalesce(text, '')")}, {_text(licences.LETTERS)})
    THEN list_transform(string_split({marked}, chr(1)), lambda s: {plain}) ELSE [] END AS said
  FROM documents),
cued AS (
  SELECT doc_id, list_transform(list_filter(said, lambda s: regexp_matches(s, {_text(licences.CUES)})),
    lambda s: CASE WHEN regexp_matches(s, {_text(licences.OWNED)}) THEN 'copyright <holder>' ELSE s END) AS said FROM cut),
known AS (SELECT doc_id, len(said) AS cues, list_filter(list_transform(said, lambda s: MAP {{{known}}}[s]), lambda x: x IS NOT NULL) AS ids FROM cued),
r0 AS (SELECT doc_id, cues, ids, []::VARCHAR[] AS found, '|' || array_to_string(ids, '||') || '|' AS rest FROM known),
{", ".join(steps)}
SELECT doc_id, array_to_string(found, ',') AS licences, array_to_string(ids, ',') AS sentence_ids,
  len(list_filter(string_split_regex(rest, '[|]+'), lambda x: x <> '' AND x <> '-'))::BIGINT AS n_unmatched, (cues - len(ids))::BIGINT AS n_unknown
FROM {last}"""


def _secret_sql() -> str:
    """Places from the lengths of matches and of what lies between them."""
    parts = []
    for rank, rule in enumerate(secret_ledger.RULES):
        pattern = _text(rule.pattern.replace("*+", "*").replace("++", "+").replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"))
        parts.append(f"""
SELECT row, {rank} AS rank, {_text(rule.kind)} AS kind, unnest(list_transform(range(1, len(hit) + 1), lambda i: {{
    'start': list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0),
    'size': length(hit[i]), 'held': length(held[i])}})) AS place
FROM (SELECT row, regexp_extract_all(text, {pattern}, 0) AS hit, regexp_extract_all(text, {pattern}, {rule.group}) AS held,
  string_split_regex(text, {pattern}) AS gap FROM docs WHERE regexp_matches(text, {pattern}))""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE)
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secret_ledger.RULES)
    every, old = len(secret_ledger.RULES), len({r.key for r in secret_ledger.RULES} & {r.key for r in secret_ledger.EARLIER})
    one = "kind || ':' || place.start::BIGINT || ':' || (place.start + place.size)::BIGINT"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
good AS (SELECT * FROM spans WHERE place.held >= CASE kind {least} END),
per_row AS (
  SELECT row, {counts}, string_agg({one}, ',' ORDER BY place.start, rank) FILTER (rank < {len(secret_ledger.BASE)}) AS base,
    string_agg({one}, ',' ORDER BY place.start, rank) AS spans FROM good GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_ledger.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CASE WHEN text IN (SELECT text FROM docs WHERE doc_id % 2 = 0) THEN {every - old} ELSE {every} END AS n_scanned
FROM docs LEFT JOIN per_row USING (row)"""


def _repair_sql() -> str:
    """The least cost and edits into every state, row by row; the edits' text decides between equal costs."""
    crc = """xor(4294967295, list_reduce(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c, ch: list_reduce(range(8), lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, ascii(ch)::BIGINT)),
      4294967295::BIGINT))"""
    name = {2: "user", 3: "assistant"}
    add = lambda of, cost, letter, line: f"{{'c': {of}.c + {cost}, 't': {of}.t || '{letter}', 'r': {of}.r || {line}}}"
    put = lambda of, to: add(of, 3, "I", f"chr(10) || '{name[to]}:'")
    more = "CASE WHEN x.late THEN 3 ELSE 0 END"
    must = "CASE WHEN x.code IN ('_', '=') THEN 1000000000 ELSE 0 END"
    keep = lambda of, kind: add(of, f"CASE WHEN x.code = '{kind}' THEN {more} ELSE 1000000000 END", "K", "chr(10) || x.role || ':' || x.text")
    role = lambda of, to: add(of, f"3 + {more} + {must}", "R", f"chr(10) || '{name[to]}:' || x.text")
    drop = lambda of: add(of, 4, "D", "''")
    least = lambda *of: f"list_sort([{', '.join(of)}])[1]"
    filled = f"{{'s': a.s, 'y': a.y, 'u': {least('a.u', put('a.s', 2), put('a.y', 2), put('a.n', 2))}, 'n': a.n}}"
    twice = f"{{'s': b.s, 'y': b.y, 'u': b.u, 'n': {least('b.n', put('b.u', 3))}}}"
    moved = f"""{{'s': {drop('e.s')}, 'y': {least(drop('e.y'), keep('e.s', 's'))},
      'u': {least(drop('e.u'), *[f(of, k) for of in ('e.s', 'e.y', 'e.n') for f, k in ((keep, 'u'), (role, 2))])},
      'n': {least(drop('e.n'), keep('e.u', 'a'), role('e.u', 3))}}}"""
    never = "{'c': 1000000000::BIGINT, 't': '', 'r': ''}"
    start = f"{{'s': {{'c': 0::BIGINT, 't': '', 'r': ''}}, 'y': {never}, 'u': {never}, 'n': {never}}}"
    apply = lambda value, names, body: f"list_transform([{value}], lambda {names}: {body})[1]"
    step = apply(apply(filled, "b", twice), "e", moved)
    return rf"""
WITH hurt AS (
  SELECT conv_id, turn, h, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {crc} % 20 AS h FROM conversations)),
rows AS (SELECT conv_id, turn, role, text FROM hurt WHERE h <> 0 UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE h = 3),
judged AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM rows),
coded AS (
  SELECT *, CASE WHEN said = '' THEN '_' WHEN again THEN '=' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS code,
    said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS late FROM judged),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (code = '_') AS blank,
    count(*) FILTER (code = '=') AS duplicate, count(*) FILTER (late) AS truncated,
    list({{'code': code, 'late': late, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, left(text, 100), text, again) AS row
  FROM coded GROUP BY conv_id),
folded AS (SELECT *, list_reduce(row, lambda a, x: {step}, {start}) AS z FROM told),
ended AS (
  SELECT *, list_sort([z.s, z.n, {put('z.u', 3)}, {apply(put('z.y', 2), 'q', put('q', 3))}])[1] AS best,
    len(list_filter(range(1, len(row)), lambda i: (left(row[i].role, 1) || left(row[i + 1].role, 1)) NOT IN ('su', 'ua', 'au'))) AS illegal FROM folded),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.t, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM every LEFT JOIN ended ON every.conv_id IS NOT DISTINCT FROM ended.conv_id"""


def _vector_sql() -> str:
    """Every part against every entry, round by round."""
    size = "len(v) // 4"
    assigned = lambda book: f"""(
  SELECT id, i, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
    SELECT parts.id, parts.i, parts.p, book.e, list_sum(list_transform(list_zip(parts.p, book.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN {book} AS book USING (i)) GROUP BY id, i, p)"""  # noqa: E731
    rounds = ""
    for n in range(1, vector_codes.ROUNDS + 1):
        rounds += f"""
a{n} AS MATERIALIZED (SELECT i, e, p FROM {assigned(f"book{n - 1}")}),
m{n} AS (
  SELECT i, e, list(floor_of ORDER BY k) AS c FROM (
    SELECT i, e, k, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_of
    FROM (SELECT i, e, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM a{n}) GROUP BY i, e, k) GROUP BY i, e),
book{n} AS MATERIALIZED (SELECT i, e, coalesce(m{n}.c, old.c) AS c FROM book{n - 1} AS old LEFT JOIN m{n} USING (i, e)),"""
    last = f"book{vector_codes.ROUNDS}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, vec_id, i, v[i * ({size}) + 1:(i + 1) * ({size})] AS p FROM kept, range({vector_codes.PARTS}) AS t(i)),
book0 AS (SELECT i, e, p AS c FROM (SELECT i, p, row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {vector_codes.ENTRIES}),{rounds}
told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY i, e)) AS codebooks_sha256 FROM {last}),
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY i) AS code, sum(d)::BIGINT AS error FROM {assigned(last)} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id), told"""


ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _vector_sql(), "op13_conversation_repair": _repair_sql(), "op2_licences": _licence_sql(), "op5_secrets": _secret_sql()}
