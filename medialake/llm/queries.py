"""The registered queries of the training-data operators, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_media(spark, sf_dir):
    from .media import media_column

    return media_column(_documents(spark, sf_dir))


def op2_preferences(spark, sf_dir):
    from .chat import preference_format, sampled_pairs

    out = preference_format(sampled_pairs(_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return out.select("pair_id", "prompt_turns", "prompt", "chosen_completion", "rejected_completion", spans("chosen_loss").alias("chosen_loss"), spans("rejected_loss").alias("rejected_loss"))


def op3_decontaminate(spark, sf_dir):
    from .decontaminate import contamination

    return contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), ["doc_id"])


def op4_toxicity(spark, sf_dir):
    from .toxicity import fit, held_out, toxicity_scores

    docs = _documents(spark, sf_dir)
    scored = toxicity_scores(docs, fit(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_substrings(spark, sf_dir):
    from .substring import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op6_tokens(spark, sf_dir):
    import public_tokenizers

    from .tokens import tokenize

    return tokenize(_documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))


def op7_secrets(spark, sf_dir):
    from .secret_scan import scan, train_scanner

    docs = _documents(spark, sf_dir)
    return scan(docs, train_scanner(docs), ["doc_id"])


def op8_neardup(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op9_shards(spark, sf_dir):
    from .sharding import shard_documents

    return shard_documents(_documents(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op11_ranked(spark, sf_dir):
    from .ranking import rank_documents

    return rank_documents(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_repair(spark, sf_dir):
    from .repair import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_mix(spark, sf_dir):
    from .mixing import mix_sources, taken_words

    return taken_words(mix_sources(_documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_media, op2_preferences, op3_decontaminate, op4_toxicity, op5_substrings, op6_tokens, op7_secrets, op8_neardup, op9_shards, op10_bpe, op11_ranked, op12_repair, op13_mix)}

ORACLE: dict[str, str] = {}

ORACLE["op2_preferences"] = r"""
WITH conv AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (
  SELECT conv_id, turns, list_max(list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i ELSE 0 END)) AS pos FROM conv),
replies AS (SELECT xor(conv_id, 1) AS conv_id, turns[pos] AS other FROM cut WHERE pos > 0),
pairs AS (
  SELECT c.conv_id AS pair_id, c.turns[1:c.pos] AS a, list_append(c.turns[1:c.pos - 1], r.other) AS b
  FROM cut c JOIN replies r ON c.conv_id = r.conv_id WHERE c.pos > 0),
lcp AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM pairs),
parts AS (SELECT pair_id, n, a[1:n] AS p, a[n + 1:len(a)] AS c, b[n + 1:len(b)] AS r FROM lcp),
done AS (
  SELECT *,
    list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(list_transform(c[1:i - 1], lambda t: length(t.role) + length(t.text) + 6)), 0)) AS co,
    list_transform(range(1, len(r) + 1), lambda i: coalesce(list_sum(list_transform(r[1:i - 1], lambda t: length(t.role) + length(t.text) + 6)), 0)) AS ro
  FROM parts)
SELECT pair_id, CAST(n AS INTEGER) AS prompt_turns,
  coalesce(list_aggregate(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), 'string_agg', ''), '') AS chosen_completion,
  coalesce(list_aggregate(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), 'string_agg', ''), '') AS rejected_completion,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: CAST(CAST(co[i] + length(c[i].role) + 5 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(co[i] + length(c[i].role) + 6 + length(c[i].text) AS BIGINT) AS VARCHAR)), 'string_agg', ','), '') AS chosen_loss,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: CAST(CAST(ro[i] + length(r[i].role) + 5 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ro[i] + length(r[i].role) + 6 + length(r[i].text) AS BIGINT) AS VARCHAR)), 'string_agg', ','), '') AS rejected_loss
FROM done
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op3_decontaminate"] = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k),
hits AS (SELECT r, i, g.k, item_id FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM windows) x JOIN grams g ON g.k = x.k AND g.gram = x.gram),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
owners AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN owners USING (r)
"""

ORACLE["op5_substrings"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT gram, min(doc_id) AS owner FROM windows GROUP BY gram),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (gram) WHERE owner < doc_id),
spots AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(ps, [])) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN spots USING (r)
"""

_SETS = r"""
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs)"""

ORACLE["op8_neardup"] = f"""
WITH RECURSIVE {_SETS},
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM docs UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
low AS (SELECT u, min(v) AS root FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN low ON doc_id = u
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op11_ranked"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM docs),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
wanted AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM items) GROUP BY q, item_id, term),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM counts, corpus GROUP BY term),
impacts AS (
  SELECT r, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * big_n) // big_l)) AS impact FROM counts JOIN docs USING (r), corpus),
scores AS (
  SELECT q, item_id, r, CAST(sum(times * weight * impact) AS BIGINT) AS score FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _plus(key: str, cost: str, edit: str) -> str:
    """A way so far is its cost, in eight digits, and its edits; so the least string is the best way."""
    return f"lpad(CAST(CAST(substr({key}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({key}, 9) || '{edit}'"


def _taken(state: int) -> str:
    """The best way to a state behind row ``x``, from the ways to all states before it."""
    ways = [_plus(f"k{state}", "4", "D")]
    for before, initial in {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}.get(state, []):
        ways.append(f"CASE WHEN NOT x.gone AND left(x.role, 1) = '{initial}' THEN {_plus(f'k{before}', 'x.cut', 'K')} END")
        if initial != "s":
            ways.append(f"CASE WHEN NOT x.gone THEN {_plus(f'k{before}', '(3 + x.cut)', 'R')} END")
    return f"least({', '.join(ways)})"


_SPACE = r"\x20\x09-\x0D"

ORACLE["op12_repair"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM range(256) r(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))) AS bytes
  FROM conversations),
kinds AS (SELECT * EXCLUDE (bytes), xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^{_SPACE}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[.!?][{_SPACE}]*$') AS ended_badly FROM damaged),
marked AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND ended_badly THEN 3 ELSE 0 END AS cut FROM judged),
convs AS (
  SELECT conv_id, list(struct_pack(role := role, text := text, gone := gone, cut := cut) ORDER BY turn NULLS FIRST, role, md5(text), copy) AS xs,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut > 0) AS truncated
  FROM marked GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0 AS i, xs, '00000000' AS k0, CAST(NULL AS VARCHAR) AS k1, '00000003I' AS k2, '00000006II' AS k3 FROM convs
  UNION ALL
  SELECT conv_id, i, xs, k0, k1, k2, least(k3, {_plus("k2", "3", "I")}) FROM (
    SELECT conv_id, i, xs, k0, k1, least(k2, {_plus("k0", "3", "I")}, {_plus("k1", "3", "I")}, {_plus("k3", "3", "I")}) AS k2, k3 FROM (
      SELECT conv_id, i + 1 AS i, xs, {_taken(0)} AS k0, {_taken(1)} AS k1, {_taken(2)} AS k2, {_taken(3)} AS k3
      FROM (SELECT *, xs[i + 1] AS x FROM ways WHERE i < len(xs)) a) b) c),
best AS (SELECT conv_id, least(k0, k3) AS k FROM ways WHERE i = len(xs)),
scripts AS (SELECT conv_id, CAST(substr(k, 1, 8) AS BIGINT) AS cost, substr(k, 9) AS audit FROM best),
replay AS (
  SELECT c.conv_id, xs, audit, 0 AS p, 0 AS j, '' AS last, CAST([] AS VARCHAR[]) AS lines FROM convs c JOIN scripts s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
  UNION ALL
  SELECT conv_id, xs, audit, p + 1, j + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE e WHEN 'D' THEN last WHEN 'K' THEN left(x.role, 1) ELSE left(named, 1) END,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, x.role || ':' || x.text) WHEN 'R' THEN list_append(lines, named || ':' || x.text) ELSE list_append(lines, named || ':') END
  FROM (SELECT *, audit[p + 1] AS e, xs[j + 1] AS x, CASE WHEN last = 'u' THEN 'assistant' ELSE 'user' END AS named FROM replay WHERE p < len(audit)) d),
repaired AS (SELECT conv_id, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256 FROM replay WHERE p = len(audit)),
pairs AS (SELECT conv_id, len(list_filter(range(1, len(xs)), lambda i: left(xs[i].role, 1) || left(xs[i + 1].role, 1) NOT IN ('su', 'ua', 'au'))) AS illegal FROM convs)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  CAST(coalesce(p.illegal, 0) AS BIGINT) AS illegal, coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit, coalesce(r.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN scripts s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN pairs p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
"""
