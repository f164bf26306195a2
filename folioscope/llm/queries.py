"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.chat import chats
from folioscope.llm.common import scratch_path, table
from folioscope.llm.decontaminate import contamination_digests
from folioscope.llm.licenses import scan_licences
from folioscope.llm.line_dedup import line_digests
from folioscope.llm.mixing import Mix, select_tokens
from folioscope.llm.odd_sketch import near_copies
from folioscope.llm.quality import RULES as QUALITY_RULES
from folioscope.llm.quality import judge
from folioscope.llm.secrets import RULES, secret_digests
from folioscope.llm.simhash import hex_fingerprint, near_duplicates
from folioscope.llm.spelling import spelling_variants
from folioscope.llm.suffix_dedup import repeat_digests
from folioscope.llm.warc import round_trip
from folioscope.llm.whitening import whiten


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), radius=2, shingle=3)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages"), min_bytes=0)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return select_tokens(table(spark, folder, "documents"), Mix()).drop("row_key")


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chats(table(spark, folder, "conversations")).withColumn("conv_id", F.col("conv_id").cast("long"))


def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licences(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        "spans",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        "n_unknown",
    )


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"), width=10)


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(table(spark, folder, "documents"), store=scratch_path(spark, "secret-ledger"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_digests(table(spark, folder, "documents"), min_docs=10).drop("keep_bitmap")


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digests(table(spark, folder, "documents"), width=50)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), components=16)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"), ratio=2, least_length=5, least=3, damage=97)


def op13_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"), shingle=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_licences": op5_licences,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_odd_sketch": op13_odd_sketch,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DIGIT = "((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)"

_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _filled(source: str, parent: str, path: str, name: str) -> str:
    """The water filling of one level: ``path`` and ``given`` of the nodes in ``source``."""
    group = f"PARTITION BY {parent} " if parent else ""
    before = f"OVER ({group}ORDER BY room / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    level = f"(budget - coalesce(sum(room) {before}, 0)) / (sum(weight) OVER ({group}) - coalesce(sum(weight) {before}, 0))"
    return f"SELECT {path}, least(room, weight * max(level) OVER ({group})) AS given FROM (SELECT *, {level} AS level FROM {source})"


def _mixing_sql() -> str:
    mix = Mix()
    values = ", ".join(f"coalesce({lv.value}, '') AS {lv.name}" for lv in mix.levels)
    names = [lv.name for lv in mix.levels]
    ctes = [
        f"t AS (SELECT doc_id, text, {values}, len({_TOKENS}) AS n_tokens FROM documents)",
        f"g AS (SELECT doc_id, text, {', '.join(names)}, n_tokens, count(*) AS n_rows FROM t WHERE n_tokens > 0 GROUP BY ALL)",
        f"leaf AS (SELECT {', '.join(names)}, sum(n_tokens * n_rows)::BIGINT AS supply FROM g GROUP BY ALL)",
    ]
    for depth, lv in enumerate(mix.levels):
        path, parent = ", ".join(names[: depth + 1]), ", ".join(names[:depth])
        budget = f"(SELECT sum(supply)::DOUBLE * {mix.share} FROM leaf)" if not depth else "any_value(given)"
        above = f" JOIN f{depth - 1} USING ({parent})" if depth else ""
        ctes.append(f"n{depth} AS (SELECT *, ({lv.weight})::DOUBLE AS weight FROM (SELECT {path}, sum(supply::DOUBLE * {mix.max_epochs}) AS room, {budget} AS budget FROM leaf{above} GROUP BY {path}))")
        ctes.append(f"f{depth} AS ({_filled(f'n{depth}', parent, path, lv.name)})")
    last, keys = len(mix.levels) - 1, ", ".join(names)
    ctes.append(f"p AS (SELECT {keys}, supply, floor(given + 1e-6)::BIGINT AS budget FROM leaf JOIN f{last} USING ({keys}))")
    ctes.append(f"e AS (SELECT *, budget // supply AS full_epochs, budget % supply AS rest FROM p)")
    ctes.append(f"o AS (SELECT *, ('0x' || substr(md5('{mix.seed}:' || full_epochs || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM g JOIN e USING ({keys}))")
    ctes.append(f"s AS (SELECT *, coalesce(sum(n_tokens * n_rows) OVER (PARTITION BY {keys} ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)")
    ctes.append("r AS (SELECT *, greatest(0, least(n_tokens * n_rows, rest - start))::BIGINT AS last_epoch_tokens FROM s)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, {keys}, n_tokens, n_rows, full_epochs, last_epoch_tokens FROM r WHERE full_epochs > 0 OR last_epoch_tokens > 0"


def _secrets_sql() -> str:
    def spans(rule, k: int) -> str:
        pattern = rule.pattern.replace("'", "''")
        found = f"regexp_extract_all(body, '{pattern}')"
        return (
            f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, e - n AS s, e FROM (SELECT doc_id, n, held, list_sum(gaps[:i]) + list_sum(sizes[:i]) AS e FROM (SELECT doc_id, "
            f"unnest(range(1, len(sizes) + 1)) AS i, unnest(sizes) AS n, unnest(helds) AS held, gaps, sizes FROM (SELECT doc_id, "
            f"list_transform(string_split_regex(body, '{pattern}'), lambda x: length(x)) AS gaps, list_transform({found}, lambda x: length(x)) AS sizes, "
            f"list_transform(regexp_extract_all(body, '{pattern}', {rule.group}), lambda x: length(x) >= {rule.least}) AS helds FROM d))) WHERE held"
        )

    every = " UNION ALL ".join(spans(r, k) for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    joined = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k), '')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), x AS ({every}) "
        f"SELECT doc_id, {counts}, sha256({joined}) AS base_sha256, {joined} AS spans, sha256(any_value(body)) AS blob_id FROM d LEFT JOIN x USING (doc_id) GROUP BY doc_id"
    )


def _repeats_sql(width: int = 50) -> str:
    return f"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, {2 * width}) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {width - 1})) AS pos FROM h WHERE length(h) >= {2 * width})),
        f AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY g) AS low FROM p) WHERE low < doc_id),
        i AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM
            (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {width} THEN 0 ELSE 1 END AS fresh FROM f)),
        s AS (SELECT doc_id, min(pos) AS s, max(pos) + {width} AS e FROM i GROUP BY doc_id, run),
        k AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS after FROM s),
        a AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS kept,
            string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM k JOIN h USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(spans, '') AS spans FROM h LEFT JOIN a USING (doc_id)"""


def _quality_sql(alpha: float = 0.01, delta: float = 0.05) -> str:
    depth = max(len(c) for _, c in QUALITY_RULES.values())
    steps = [(rule, c[k]) for k in range(depth) for rule, (_, c) in QUALITY_RULES.items() if k < len(c)]
    value = {rule: "({}::DOUBLE / nullif({}, 0))".format(*expr.split(" / ")) for rule, (expr, _) in QUALITY_RULES.items()}
    first = "least(" + ", ".join(f"CASE WHEN {value[rule]} > {cutoff} THEN {k} END" for k, (rule, cutoff) in enumerate(steps)) + ")"
    table = ", ".join(f"({k}, '{rule}', {cutoff}::DOUBLE)" for k, (rule, cutoff) in enumerate(steps))
    broken = ", ".join(f"CASE WHEN {value[rule]} > c_{rule} THEN '{rule}' END" for rule in QUALITY_RULES)
    wide = ", ".join(f"min(cutoff) FILTER (WHERE rule = '{rule}') AS c_{rule}" for rule in QUALITY_RULES)
    tail = f"list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))))"
    count = "(length(body) - length(regexp_replace(body, '{}', '', 'g')))"
    return f"""WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS body, {_TOKENS} AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)),
        rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS times FROM win) WHERE times > 1) GROUP BY doc_id),
        f AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
            {count.format('[#*$%&|<>]')}::BIGINT AS n_symbols, (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
            coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, {count.format('!')} AS n_marks, {count.format('[A-Z]')} AS n_capitals FROM d LEFT JOIN rep USING (doc_id)),
        good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        one AS (SELECT stratum, {first} AS first FROM f JOIN good USING (doc_id)),
        c AS (SELECT stratum, k, rule, cutoff, (SELECT count(*) FROM one o WHERE o.stratum IS NOT DISTINCT FROM s.stratum) AS n,
            (SELECT count(*) FROM one o WHERE o.stratum IS NOT DISTINCT FROM s.stratum AND o.first <= t.k) AS x FROM (SELECT DISTINCT stratum FROM one) s CROSS JOIN (VALUES {table}) t(k, rule, cutoff)),
        v AS (SELECT *, CASE WHEN x > n * {alpha} THEN TRUE ELSE {tail} > {delta} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM one)) END AS fails FROM c),
        held AS (SELECT stratum, {wide} FROM v WHERE k < coalesce((SELECT min(k) FROM v w WHERE w.fails AND w.stratum IS NOT DISTINCT FROM v.stratum), {len(steps)}) GROUP BY stratum),
        j AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{broken}], lambda r: r IS NOT NULL) AS broken FROM f LEFT JOIN held h ON f.stratum IS NOT DISTINCT FROM h.stratum)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS rejected_by FROM j"""


def _spelling_sql(least_length: int = 5, least: int = 3, damage: int = 97, ratio: int = 2) -> str:
    # DuckDB has no CRC-32, so its table is made by its rule and the bytes are folded over it.
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, (2 * k + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]))"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    return f"""WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step}) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
        r AS MATERIALIZED (SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
        h AS (SELECT run, c, xor({crc}, 4294967295::BIGINT) AS h FROM (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r) CROSS JOIN tab),
        w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {damage} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= {least_length} GROUP BY word HAVING sum(c) >= {least}),
        p AS MATERIALIZED (SELECT word, n, left(word, i - 1) || '?' || substr(word, i + 1) AS swap, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS MATERIALIZED (SELECT a.word, b.word AS v, b.n AS m FROM p a JOIN p b ON a.swap = b.swap AND a.word <> b.word UNION SELECT p.word, w.word, w.n FROM p JOIN w ON p.less = w.word UNION SELECT w.word, p.word, p.n FROM p JOIN w ON p.less = w.word),
        best AS (SELECT word, count(*) AS n_near, first(v ORDER BY m DESC, v) AS v, max(m) AS m FROM near GROUP BY word),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN v END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS here FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.here = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT walk.word, walk.here AS root FROM walk JOIN f ON walk.here = f.word WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""


def _near_copies_sql(percent: int = 80) -> str:
    words = _TOKENS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS words FROM documents),
        s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS g FROM d),
        t AS MATERIALIZED (SELECT row_number() OVER () AS node, * FROM (SELECT g, len(g) AS n, min(doc_id) AS low FROM s WHERE len(g) > 0 GROUP BY g)),
        x AS MATERIALIZED (SELECT node, n, unnest(g) AS k FROM t),
        o AS (SELECT node, n, k, row_number() OVER (PARTITION BY node ORDER BY df, k) AS place FROM x JOIN (SELECT k, count(*) AS df FROM x GROUP BY k) USING (k)),
        p AS MATERIALIZED (SELECT * FROM o WHERE place <= n - (n * {percent} + 99) // 100 + 1),
        c AS (SELECT DISTINCT a.node AS u, b.node AS v FROM p a JOIN p b ON a.k = b.k AND a.node < b.node AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
        e AS (SELECT u, v FROM (SELECT u, v, a.n AS n, b.n AS m, len(list_intersect(a.g, b.g)) AS k FROM c JOIN t a ON a.node = u JOIN t b ON b.node = v) WHERE 100 * k >= {percent} * (n + m - k)),
        pair AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r AS (SELECT node, node AS other FROM t UNION SELECT r.node, pair.v FROM r JOIN pair ON r.other = pair.u),
        f AS (SELECT r.node, min(t.low) AS low FROM r JOIN t ON r.other = t.node GROUP BY r.node)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE f.low END AS component_id, s.doc_id IS NOT DISTINCT FROM (CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE f.low END) AS kept
        FROM s LEFT JOIN t USING (g) LEFT JOIN f USING (node)"""


#: The operators that SQL can express; the others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": _mixing_sql(),
    "op7_secrets": _secrets_sql(),
    "op9_suffix_dedup": _repeats_sql(),
    "op10_quality": _quality_sql(),
    "op12_spelling": _spelling_sql(),
    "op13_odd_sketch": _near_copies_sql(),
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        last AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_DIGIT}, 1)), '') AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p JOIN last USING (body)""",
    "op6_decontaminate": f"""WITH w AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
        win AS (SELECT DISTINCT item_id, words[pos:pos + 9] AS win, least(len(words), 10) AS n
            FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS pos FROM w WHERE len(words) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
        c AS (SELECT doc_id, pos, n, win, words[pos:pos + n - 1] = win AS exact FROM p JOIN (SELECT DISTINCT win, n FROM win) x ON p.word = win[1]
            WHERE len(list_filter(range(2, n + 1), lambda k: NOT list_contains(words[greatest(1, pos + k - 3):pos + k + 1], win[k]))) = 0),
        m AS (SELECT DISTINCT doc_id, pos, c.n, item_id FROM c JOIN win USING (win) WHERE exact),
        h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
        r AS (SELECT doc_id, count(*) AS n_near FROM c WHERE NOT exact GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "op8_line_dedup": f"""WITH l AS (SELECT r, doc_id, line, pos, {_LOWER.format(f"trim(line, {_BLANKS})")} AS k
            FROM (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM (SELECT *, row_number() OVER () AS r FROM documents))),
        f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN f ON l.k = f.k GROUP BY r, doc_id""",
}
