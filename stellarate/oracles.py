"""DuckDB statements that give the same rows as the queries of the same name."""

from __future__ import annotations

from collections.abc import Iterable

from stellarate.functions.sampling import threshold
from stellarate.functions.text import CONTRACTIONS
from stellarate.queries import CONTRACTED, SEED

QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}

# Spark's English stop words.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't",
    "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]

SCORED = """
SELECT (l.quality > 0.5)::INT::DOUBLE AS label, (l.toxic = 0)::INT::DOUBLE AS prediction,
       d.n_chars::DOUBLE AS score
FROM documents d JOIN labels l USING (doc_id)
"""

LABELLED = "SELECT * FROM documents LEFT JOIN labels USING (doc_id)"

GAPPY = "SELECT * REPLACE (nullif(event_type, 'error') AS event_type) FROM events"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def union(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long_stats(table: str, stats: dict[str, dict[str, str]], digits: int = 4) -> list[str]:
    """One SELECT per cell: {column: {stat: aggregate}} to (column, stat, value)."""
    return [
        f"SELECT '{column}' AS \"column\", '{stat}' AS stat, "
        f"round(({aggregate})::DOUBLE, {digits}) AS value FROM {table}"
        for column, cells in stats.items()
        for stat, aggregate in cells.items()
    ]


def described(column: str) -> dict[str, str]:
    return {
        "count": f"count({column})",
        "mean": f"avg({column})",
        "std": f"stddev_samp({column})",
        "min": f"min({column})",
        "max": f"max({column})",
        **{q: f"quantile_cont({column}::DOUBLE, {share})" for q, share in QUARTILES.items()},
    }


def typed_cells(
    table: str,
    numeric: dict[str, list[str]],
    strings: dict[str, list[str]],
    longs: tuple[str, ...] = (),
) -> str:
    """(column, stat, value, text) cells; extremes of ``longs`` stand in the text as well."""
    names = {"count": "count({c})", "mean": "avg({c})", "stddev": "stddev_samp({c})",
             "min": "min({c})", "max": "max({c})"}
    parts = [
        f"SELECT '{c}' AS \"column\", '{stat}' AS stat, "
        f"round(({names[stat].format(c=c)})::DOUBLE, 4) AS value, "
        + (f"{stat}({c})::VARCHAR" if c in longs and stat in ("min", "max") else "NULL::VARCHAR")
        + f" AS text FROM {table}"
        for c, stats in numeric.items()
        for stat in stats
    ]
    for c, stats in strings.items():
        for stat in stats:
            value = f"count({c})::DOUBLE" if stat == "count" else "NULL::DOUBLE"
            text = f"{stat}({c})" if stat in ("min", "max") else "NULL::VARCHAR"
            parts.append(
                f"SELECT '{c}' AS \"column\", '{stat}' AS stat, {value} AS value, "
                f"{text} AS text FROM {table} HAVING count(*) >= 0"
            )
    return union(parts)


def profiled(table: str, types: dict[str, str], numeric: list[str], duplicates: bool = True) -> str:
    """The long profile; ``types`` are Spark's type names by column."""
    any_null = " OR ".join(f"{c} IS NULL" for c in types)
    cells = [
        ("(table)", "rows", "count(*)", None),
        ("(table)", "null_rows", f"count(*) FILTER ({any_null})", None),
    ]
    for c, kind in types.items():
        cells += [
            (c, "type", "NULL::DOUBLE", kind),
            (c, "non_null", f"count({c})", None),
            (c, "nulls", f"count(*) - count({c})", None),
        ]
    for c in numeric:
        cells += [(c, stat, aggregate, None) for stat, aggregate in described(c).items()]
    if duplicates:
        cells.append(
            ("(table)", "duplicate_rows",
             f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))", None)
        )
    return union(
        f"SELECT '{table}' AS source, '{c}' AS \"column\", '{stat}' AS stat, "
        f"round(max(v)::DOUBLE, 4) AS value, "
        + ("max(v)::VARCHAR" if stat in ("min", "max") and types.get(c) == "bigint"
           else quoted(text) if text else "NULL::VARCHAR")
        + f" AS text "
        f"FROM (SELECT {aggregate} AS v FROM {table})"
        for c, stat, aggregate, text in cells
    )


def edge(lo: str, hi: str, bins: str, number: str) -> str:
    return (
        f"CASE WHEN {number} = {bins} THEN {hi} "
        f"ELSE {lo} + ({number}) * (({hi} - {lo}) / {bins}) END"
    )


def bin_of(x: str, lo: str, hi: str, bins: str) -> str:
    guess = f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {bins})::BIGINT, {bins} - 1)"
    return (
        f"CASE WHEN {x} < {edge(lo, hi, bins, guess)} THEN {guess} - 1 "
        f"WHEN {x} >= {edge(lo, hi, bins, f'({guess} + 1)')} AND {guess} < {bins} - 1 "
        f"THEN {guess} + 1 ELSE {guess} END"
    )


def draw(*keys: str) -> str:
    parts = ", ".join(f"{key}::VARCHAR" for key in keys)
    return f"substr(md5(concat_ws('|', {parts}, '{SEED}')), 1, 8)"


def expanded(column: str) -> str:
    for short, full in CONTRACTIONS.items():
        column = f"replace({column}, {quoted(short)}, {quoted(full)})"
    return column


# The whitespace characters, as an RE2 class body.
SPACES = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORDS = f"len(regexp_extract_all(text, '[^{SPACES}]+'))::INT"
TOKENS = r"regexp_extract_all(lower({0}), '\w+')"
STOP_LIST = ", ".join(quoted(word) for word in ENGLISH_STOP_WORDS)


def kept(column: str) -> str:
    return f"list_filter({TOKENS.format(column)}, lambda w: w NOT IN ({STOP_LIST}))"


CONTRACTED_DOCUMENTS = f"(SELECT doc_id, text || {quoted(CONTRACTED)} AS text FROM documents)"

ROC = f"""
WITH s AS ({SCORED}),
g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM g WINDOW w AS (ORDER BY score DESC))
"""

JOINED = """
SELECT l_partkey AS partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_returnflag, l_linestatus, p_brand, p_retailprice AS part_price,
       l_quantity * p_retailprice AS spent
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

EVENT_NUMBERS = {c: described(c) for c in ("event_id", "user_id", "value")}

AUTO_HISTOGRAM = f"""
WITH v AS (SELECT value AS x FROM events),
s AS (SELECT min(x) AS lo, max(x) AS hi, count(*)::DOUBLE AS n,
             quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v),
b AS (SELECT lo, hi, ceil((hi - lo) / CASE WHEN iqr > 0
          THEN least(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1))
          ELSE (hi - lo) / (log2(n) + 1) END)::BIGINT AS bins FROM s),
c AS (SELECT {bin_of("x", "lo", "hi", "bins")} AS bin, lo, hi, bins FROM v, b)
SELECT bin, round({edge("lo", "hi", "bins", "bin")}, 6) AS lower,
       round({edge("lo", "hi", "bins", "(bin + 1)")}, 6) AS upper, count(*) AS count
FROM c GROUP BY bin, lo, hi, bins
"""

EQUAL_HISTOGRAM = f"""
WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
c AS (SELECT {bin_of("l_quantity", "lo", "hi", "10")} AS bin, count(*) AS n
      FROM lineitem, s GROUP BY 1)
SELECT r.bin, round({edge("lo", "hi", "10", "r.bin")}, 9) AS lower,
       round({edge("lo", "hi", "10", "(r.bin + 1)")}, 9) AS upper, coalesce(n, 0) AS count
FROM (SELECT range AS bin FROM range(10)) r CROSS JOIN s LEFT JOIN c ON r.bin = c.bin
"""

STEPS = [1, 5, 10, 20, 25, 30, 40, 50]
EDGE_HISTOGRAM = union(
    f"SELECT {i}::BIGINT AS bin, {low}::DOUBLE AS lower, {high}::DOUBLE AS upper, "
    f"count(*) FILTER (l_quantity >= {low} AND l_quantity "
    f"{'<=' if high == STEPS[-1] else '<'} {high}) AS count FROM lineitem"
    for i, (low, high) in enumerate(zip(STEPS, STEPS[1:]))
)


def boxes(source: str, value: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""
WITH q AS (SELECT {lead}quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
                  quantile_cont({value}, 0.75) AS q3 FROM {source} {group}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT {lead}round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3,
       round(least(min({value}) FILTER ({value} >= low), any_value(q1)), 6) AS whisker_low,
       round(greatest(max({value}) FILTER ({value} <= high), any_value(q3)), 6) AS whisker_high,
       count(*) FILTER ({value} < low OR {value} > high) AS outliers, count(*) AS rows
FROM {source} JOIN f {on} {group}
"""


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORRELATION = union(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem"
    for x in CORRELATED
    for y in CORRELATED
)

GRID = f"""
WITH s AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
                  min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem)
SELECT {bin_of("l_quantity", "xl", "xh", "20")} AS x_bin,
       {bin_of("l_extendedprice", "yl", "yh", "20")} AS y_bin, count(*) AS count
FROM lineitem, s GROUP BY ALL
"""

THIRDS = [threshold(1 / 3), threshold(2 / 3)]

TFIDF = f"""
WITH w AS (SELECT doc_id, unnest({kept("text")}) AS token FROM documents),
t AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
m AS (SELECT count(*) AS rows FROM documents),
i AS (SELECT token, df, ln((rows + 1)::DOUBLE / (df + 1)) AS idf FROM f, m)
SELECT doc_id, token, tf, df, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf
FROM t JOIN i USING (token)
"""

REVIEW_FRAME = f"""
WITH b AS (
  SELECT source AS business_id, 'Source ' || source AS business_name,
         count(*) AS business_review_count, floor(avg(quality) * 8) / 2 + 1 AS business_stars,
         CASE WHEN avg(n_chars) > 2500 THEN 'loud' ELSE 'quiet' END AS business_noiselevel,
         CASE WHEN avg((lang = 'en')::INT) > 0.6 THEN 'casual' ELSE 'touristy' END
           AS business_ambience
  FROM ({LABELLED}) GROUP BY source),
r AS (
  SELECT source AS business_id, doc_id::VARCHAR AS review_id,
         (1 + 4 * quality)::DOUBLE AS review_stars, length({expanded("text")})::INT AS revised_length
  FROM documents JOIN labels USING (doc_id)),
f AS (
  SELECT review_id, business_id, review_stars, business_name, business_review_count,
         business_stars, business_noiselevel, business_ambience, revised_length
  FROM r JOIN b USING (business_id) WHERE business_stars IS NOT NULL)
"""


def levels(column: str) -> str:
    """(v, level, width): the categories of a column by falling frequency."""
    return (
        f"SELECT {column} AS v, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS level, "
        f"count(*) OVER () AS width FROM f GROUP BY {column}"
    )


EXPLORATORY_FEATURES = f"""{REVIEW_FRAME},
a AS ({levels("business_ambience")}), n AS ({levels("business_noiselevel")})
SELECT review_id, level::INT AS position, (business_ambience = v)::INT::DOUBLE AS value
FROM f CROSS JOIN a
UNION ALL
SELECT review_id, (level + (SELECT max(width) FROM a))::INT, (business_noiselevel = v)::INT::DOUBLE
FROM f CROSS JOIN n
UNION ALL
SELECT review_id, (good + (SELECT max(width) FROM a) + (SELECT max(width) FROM n))::INT,
       ((business_stars > 2.999)::INT = good)::INT::DOUBLE
FROM f CROSS JOIN (VALUES (0), (1)) AS g(good)
"""

def product(x: str, factor: int) -> str:
    return f"((({x}) * {factor}::UBIGINT) & 4294967295::UBIGINT)"


def rotated(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) | (({x}) >> {32 - bits})) & 4294967295::UBIGINT)"


def bucket_of(token: str, buckets: int = 4096) -> str:
    """The bucket of a token without letters beyond ASCII: its murmur3 hash of 32 bits, seed 42."""

    def scrambled(x: str) -> str:
        return product(rotated(product(x, 0xCC9E2D51), 15), 0x1B873593)

    codes = f"[ord(c)::UBIGINT for c in string_split({token}, '')]"
    blocks = "[" + scrambled("b[4*i+1] + 256 * b[4*i+2] + 65536 * b[4*i+3] + 16777216 * b[4*i+4]") + (
        " for i in range(len(b) // 4)]"
    )
    step = product(rotated("xor(h, k)", 13), 5)
    body = f"list_reduce(list_prepend(42::UBIGINT, {blocks}), lambda h, k: ({step} + 3864292196) & 4294967295)"
    rest = " + ".join(
        f"CASE WHEN len(b) % 4 > {i} THEN {256**i}::UBIGINT * b[len(b) - len(b) % 4 + {i + 1}] ELSE 0::UBIGINT END"
        for i in range(3)
    )
    mixed = f"xor(xor({body}, {scrambled(rest)}), len(b)::UBIGINT)"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        mixed = f"[{product('xor(z, z >> ' + str(shift) + ')', factor)} for z in [{mixed}]][1]"
    return f"(list_transform([{codes}], lambda b: {mixed})[1] % {buckets})::INT"


TOKEN_COUNTS = f"""WITH w AS (SELECT doc_id, unnest({kept("text")}) AS token FROM documents),
t AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL),
v AS (SELECT token, count(*) AS df, sum(tf)::BIGINT AS total FROM t GROUP BY token),
i AS (SELECT *, {bucket_of("token")} AS bucket FROM v)"""
BUCKET_COUNTS = f"""{TOKEN_COUNTS}
SELECT doc_id, bucket, sum(tf)::BIGINT AS count FROM t JOIN i USING (token) GROUP BY doc_id, bucket
"""
HASHED_TFIDF = f"""
WITH w AS (SELECT doc_id, unnest({kept("revised")}) AS token
    FROM (SELECT doc_id, {expanded("text")} AS revised FROM {CONTRACTED_DOCUMENTS})),
i AS (SELECT token, {bucket_of("token")} AS bucket FROM (SELECT DISTINCT token FROM w)),
t AS (SELECT doc_id, bucket, count(*) AS tf FROM w JOIN i USING (token) GROUP BY ALL),
f AS (SELECT bucket, count(*) AS df FROM t GROUP BY bucket),
m AS (SELECT count(*) AS rows FROM documents)
SELECT doc_id, bucket, round(tf * ln((rows + 1)::DOUBLE / (df + 1)), 6) AS weight
FROM t JOIN f USING (bucket), m
"""

LEARN = f"""{REVIEW_FRAME},
l AS (SELECT *, (review_stars > 2.999)::INT AS label FROM f WHERE {draw("review_id")} < '{threshold(0.7)}'),
share AS (SELECT count(*) AS rows, avg(label) AS p FROM l)"""


def named_levels(vector: str, column: str, first: str) -> str:
    """The features of one category in order: its levels by falling frequency, then the unknown."""
    return f"""SELECT {first} + row_number() OVER (ORDER BY n DESC, v) AS i, '{vector}_' || v AS name
        FROM (SELECT {column} AS v, count(*) AS n FROM l GROUP BY v
              UNION ALL SELECT '__unknown', 0)"""


FOLD_DRAW = "substr(md5(concat_ws('|', review_id, '43')), 1, 8)"
FOLD_STATISTICS = f"""{REVIEW_FRAME},
own AS (SELECT *, ({FOLD_DRAW} >= '{THIRDS[0]}')::INT + ({FOLD_DRAW} >= '{THIRDS[1]}')::INT AS own_fold
    FROM f),
words AS (SELECT doc_id::VARCHAR AS review_id, unnest({kept("revised")}) AS token
    FROM (SELECT doc_id, {expanded("text")} AS revised FROM documents JOIN labels USING (doc_id))),
buckets AS (SELECT token, {bucket_of("token")} AS bucket FROM (SELECT DISTINCT token FROM words)),
seen AS (
    SELECT own_fold, 'rows' AS kind, '' AS key, business_review_count::DOUBLE AS x FROM own
    UNION ALL SELECT own_fold, 'business_ambience', business_ambience, NULL FROM own
    UNION ALL SELECT own_fold, 'business_noiselevel', business_noiselevel, NULL FROM own
    UNION ALL SELECT own_fold, 'term', bucket::VARCHAR, NULL FROM
        (SELECT DISTINCT review_id, bucket FROM words JOIN buckets USING (token)) JOIN own USING (review_id))
SELECT fold::INT AS fold, kind, key, count(*) AS n, min(x) AS lo, max(x) AS hi
FROM seen, range(3) r(fold) WHERE fold != own_fold GROUP BY ALL
"""

COEFFICIENT_NAMES = f"""{LEARN}, names AS (
    SELECT 0 AS i, 'countScaled_0' AS name
    UNION ALL {named_levels("ambienceVector", "business_ambience", "1000")}
    UNION ALL {named_levels("noiseVector", "business_noiselevel", "2000")}
    UNION ALL SELECT * FROM (VALUES (3000, 'starVector_0'), (3001, 'starVector_1')))
SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS idx, name FROM names
"""

ODD_EVENT = " OR ".join(f"event_id % {n} = 0" for n in (100, 89, 83, 79, 73))

PART_PROFILE = profiled(
    "part",
    {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
     "p_size": "int", "p_retailprice": "double"},
    ["p_partkey", "p_size", "p_retailprice"],
)

ORACLES: dict[str, str] = {
    "confusion": f"""
        SELECT label, count(*) FILTER (prediction = 0) AS predicted_0,
               count(*) FILTER (prediction = 1) AS predicted_1
        FROM ({SCORED}) GROUP BY label""",
    "class_metrics": f"""
        WITH c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
                          count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                          count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                          count(*) FILTER (label = 0 AND prediction = 0) AS tn
                   FROM ({SCORED})),
        m AS (SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
                     tp::DOUBLE / nullif(tp + fp, 0) AS precision,
                     tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM c)
        SELECT tp, fp, fn, tn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision,
               round(recall, 9) AS recall,
               round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1 FROM m""",
    "roc_points": f"""{ROC}
        SELECT score AS threshold, round(fp / nullif(n, 0), 9) AS fpr,
               round(tp / nullif(p, 0), 9) AS tpr FROM c
        UNION ALL SELECT NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    "auc_exact": f"""{ROC}
        SELECT round(sum(neg * (tp - pos / 2)) / nullif(max(p) * max(n), 0), 9) AS auc FROM c""",
    "roc_bounded": f"""{ROC}
        SELECT true AS few_points, true AS within, true AS narrow,
               round(sum(neg * (tp - pos / 2)) / nullif(max(p) * max(n), 0), 9) AS auc FROM c""",
    "json_roundtrip": "SELECT * FROM customer",
    "json_inferred": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "parquet_roundtrip": "SELECT * FROM part",
    "struct_lift": """
        SELECT event_id, json_extract(props, '$.k')::BIGINT AS k,
               json_extract(props, '$.k')::BIGINT AS event_k FROM events""",
    "clean_dropna": f"""
        SELECT event_id, user_id, event_type, value FROM ({GAPPY})
        WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
          AND value IS NOT NULL AND NOT isnan(value)""",
    "null_report": union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS before, "
        f"0::BIGINT AS after FROM ({GAPPY})"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
    "rename_join": JOINED,
    "rename_join_salted": JOINED,
    "bucketed_join": """
        SELECT l_partkey AS partkey, l_orderkey, l_linenumber, l_quantity, p_brand, p_retailprice
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "skewed_join": """
        SELECT l_orderkey, l_linenumber, l_returnflag, flag_lines, flag_most FROM lineitem
        JOIN (SELECT l_returnflag, count(*) AS flag_lines, max(l_quantity) AS flag_most
              FROM lineitem GROUP BY l_returnflag) USING (l_returnflag)""",
    "cleaning_job": """
        SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, user_id, value FROM events
        WHERE event_id % 100 <> 0""",
    "rejected_lines": """
        SELECT 20 AS length, count(*) AS lines FROM events WHERE event_id % 100 = 0""",
    "landing_variant": f"""
        SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k, user_id, value
        FROM events WHERE NOT ({ODD_EVENT})""",
    "variant_rejects": f"""
        SELECT event_id, count(*) AS lines FROM events WHERE {ODD_EVENT} GROUP BY event_id""",
    "schema_profile": """
        SELECT (row_number() OVER (ORDER BY column_index) - 1)::INT AS position,
               column_name AS "column",
               CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                   WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
                   ELSE 'timestamp_ntz' END AS type, true AS nullable
        FROM duckdb_columns() WHERE table_name = 'lineitem'""",
    "typed_dates": """
        SELECT min(d)::VARCHAR AS oldest, max(d)::VARCHAR AS newest,
               count(*) FILTER (d IS NULL) AS undated
        FROM (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN date_trunc('second', o_orderdate) END AS d
              FROM orders)""",
    "dup_rows_events": """
        WITH e AS (SELECT ts, user_id, event_type, value, props FROM events),
        u AS (SELECT * FROM e UNION ALL SELECT * REPLACE (CASE WHEN user_id % 3 <> 0
              THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS ts) FROM e)
        SELECT (SELECT count(*) FROM u) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u))
            AS duplicate_rows""",
    "hash_sample_null_keys": """
        SELECT o_orderkey % 2 <> 0 AS null_key, count(*) AS rows, true AS fair
        FROM orders GROUP BY 1""",
    "draws_checked": """
        SELECT unnest(['sample is a subset', 'sample has its share', 'parts are disjoint',
                       'parts cover all', 'parts have their shares']) AS "check", true AS holds""",
    "approximate_ranks": """
        SELECT c AS "column", s AS stat, true AS near
        FROM (VALUES ('o_custkey'), ('o_totalprice')) a(c), (VALUES ('25%'), ('50%'), ('75%')) b(s)""",
    "model_features": f"""
        SELECT review_id, (position + 1)::INT AS position, value FROM ({EXPLORATORY_FEATURES})
        WHERE value <> 0
        UNION ALL
        SELECT review_id, 0::INT, scaled FROM (
            SELECT review_id, CASE WHEN lo = hi THEN 0.5::DOUBLE
                   ELSE round((business_review_count - lo) / (hi - lo)::DOUBLE, 9) END AS scaled
            FROM ({REVIEW_FRAME} SELECT review_id, business_review_count,
                  min(business_review_count) OVER () AS lo,
                  max(business_review_count) OVER () AS hi FROM f))
        WHERE scaled <> 0""",
    "model_checks": """
        SELECT unnest(['four grid points', 'one best point', 'best point is fitted',
            'predictions follow scores', 'coefficients are numbered', 'roc ends', 'roc rises',
            'roc area is the auc']) AS "check", true AS holds""",
    "fit_optimality": f"""{LEARN}
        SELECT reg::DOUBLE AS reg_param, net::DOUBLE AS elastic_net_param, rows, true AS optimal,
               CASE WHEN reg = 1 AND net = 1 THEN 0::BIGINT END AS nonzero,
               CASE WHEN reg = 1 AND net = 1 THEN round(ln(p / (1 - p)), 6) END AS intercept
        FROM share, (VALUES (0), (1)) r(reg), (VALUES (0), (1)) e(net)""",
    "fold_statistics": FOLD_STATISTICS,
    "null_point_scores": f"""{LEARN}
        SELECT review_id, (review_stars > 2.999)::INT::DOUBLE AS label,
               (p > 0.5)::INT::DOUBLE AS prediction, round(p, 9) AS score
        FROM f, share WHERE {draw("review_id")} >= '{threshold(0.7)}'""",
    "coefficient_names": COEFFICIENT_NAMES,
    "expression_scores": f"""{REVIEW_FRAME}
        SELECT review_id, true AS same_score, true AS same_prediction FROM f
        WHERE {draw("review_id")} >= '{threshold(0.7)}'""",
    "scored_labels": f"""{REVIEW_FRAME}
        SELECT review_id, (review_stars > 2.999)::INT::DOUBLE AS label, true AS scored FROM f
        WHERE {draw("review_id")} >= '{threshold(0.7)}'""",
    "null_counts": f"""
        SELECT {", ".join(
            f"count(*) FILTER ({c} IS NULL) AS {c}"
            for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))}
        FROM ({LABELLED})""",
    "nonnull_counts": f"""
        SELECT {", ".join(
            f"count({c}) AS {c}"
            for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))}
        FROM ({LABELLED})""",
    "null_rows": f"""
        SELECT count(*) FILTER (doc_id IS NULL OR text IS NULL OR lang IS NULL OR source IS NULL
                                OR n_chars IS NULL OR quality IS NULL OR toxic IS NULL) AS null_rows
        FROM ({LABELLED})""",
    "null_columns": f"""
        SELECT * FROM ({union(
            f'''SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls FROM ({LABELLED})'''
            for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))})
        WHERE nulls > 0""",
    "row_counts": "SELECT count(*) AS rows FROM lineitem",
    "dup_rows": """
        SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM
            (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_rows""",
    "describe_numeric": union(long_stats("events", EVENT_NUMBERS)),
    "describe_table": typed_cells(
        "orders",
        {c: ["count", "mean", "stddev", "min", "max"]
         for c in ("o_orderkey", "o_custkey", "o_totalprice")},
        {c: ["count", "mean", "stddev", "min", "max"]
         for c in ("o_orderstatus", "o_orderpriority")},
        longs=("o_orderkey", "o_custkey"),
    ),
    "summary_subset": typed_cells(
        "orders",
        {"o_totalprice": ["count", "min", "max", "mean"]},
        {"o_orderpriority": ["count", "min", "max", "mean"]},
    ),
    "profile_table": PART_PROFILE,
    "profile_states": PART_PROFILE,
    "correlation_states": CORRELATION,
    "profile_tables": union([
        profiled(
            "customer",
            {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
             "c_acctbal": "double", "c_mktsegment": "string"},
            ["c_custkey", "c_nationkey", "c_acctbal"],
            duplicates=False,
        ),
        profiled(
            "supplier",
            {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int",
             "s_acctbal": "double"},
            ["s_suppkey", "s_nationkey", "s_acctbal"],
        ),
    ]),
    "sketch_quartiles": """
        WITH g AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL
                   UNION ALL SELECT '(all)', count(*) FROM orders)
        SELECT o_orderpriority, c AS "column", s AS stat, n, true AS within
        FROM g, (VALUES ('o_custkey'), ('o_totalprice')) t(c), (VALUES ('25%'), ('50%'), ('75%')) q(s)""",
    "date_range": """
        SELECT min(o_orderdate)::VARCHAR AS oldest, max(o_orderdate)::VARCHAR AS newest
        FROM orders""",
    "topk_values": """
        SELECT n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name ORDER BY count DESC, n_name LIMIT 10""",
    "topk_brands": """
        SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand
        ORDER BY count DESC, p_brand LIMIT 10""",
    "value_counts": f"""
        SELECT event_type, count(*) AS count FROM ({GAPPY}) WHERE event_type IS NOT NULL
        GROUP BY event_type""",
    "first_rows": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""",
    "last_rows": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10""",
    "hist_equal": EQUAL_HISTOGRAM,
    "hist_edges": EDGE_HISTOGRAM,
    "hist_auto": AUTO_HISTOGRAM,
    "boxplot": boxes("events", "value", "event_type"),
    "boxplot_total": boxes("orders", "o_totalprice"),
    "corr_matrix": CORRELATION,
    "scatter_sample": f"""
        SELECT o_custkey, o_totalprice FROM orders
        WHERE {draw("o_orderkey")} < '{threshold(0.2)}'""",
    "scatter_counts": GRID,
    "hash_sample": f"""
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE {draw("o_orderkey")} < '{threshold(0.25)}'""",
    "hash_split": f"""
        SELECT o_orderkey, ({draw("o_orderkey")} >= '{threshold(0.7)}')::INT AS part FROM orders""",
    "hash_folds": f"""
        SELECT ({draw("l_orderkey", "l_linenumber")} >= '{THIRDS[0]}')::INT
             + ({draw("l_orderkey", "l_linenumber")} >= '{THIRDS[1]}')::INT AS fold,
               count(*) AS count
        FROM lineitem GROUP BY 1""",
    "text_lengths": f"""
        SELECT doc_id, length(text)::INT AS characters,
               CASE WHEN text <> '' THEN {WORDS} END AS words FROM documents""",
    "short_text_lengths": f"""
        SELECT conv_id, turn, length(text)::INT AS characters, {WORDS} AS words
        FROM conversations""",
    "nonempty_text": """
        SELECT count(*) FILTER (length(text) > 0) AS rows_with_text FROM conversations""",
    "contractions": f"""
        SELECT doc_id, {expanded("text")} AS revised_text FROM {CONTRACTED_DOCUMENTS}""",
    "tokens": f"""
        SELECT doc_id, (unnest(range(len(w))))::INT AS position, unnest(w) AS word
        FROM (SELECT doc_id, {TOKENS.format("text")} AS w FROM documents)""",
    "stopwords": f"""
        SELECT doc_id, len(k)::INT AS n_words, coalesce(array_to_string(k, ' '), '') AS revised_words
        FROM (SELECT doc_id, {kept("revised")} AS k
              FROM (SELECT doc_id, {expanded("text")} AS revised FROM {CONTRACTED_DOCUMENTS}))""",
    "token_tfidf": TFIDF,
    "hashed_tfidf": HASHED_TFIDF,
    "bucket_index": f"""{TOKEN_COUNTS} SELECT token, df, total, bucket FROM i""",
    "bucket_terms": f"""{TOKEN_COUNTS}
        SELECT bucket, count(*) AS terms, sum(total)::BIGINT AS total,
               array_to_string(list(token ORDER BY total DESC, token)[1:3], ',') AS examples
        FROM i GROUP BY bucket""",
    "bucket_counts": BUCKET_COUNTS,
    "vector_counts": BUCKET_COUNTS,
    "binarize": """
        SELECT p_partkey, (p_size > 2.999)::INT::DOUBLE AS label,
               (nullif(p_size, 1) > 25)::INT::DOUBLE AS large FROM part""",
    "string_index": """
        WITH i AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::DOUBLE
                          AS brand_index FROM part GROUP BY p_brand)
        SELECT p_brand, p_partkey, brand_index FROM part JOIN i USING (p_brand)""",
    "index_labels": """
        SELECT p_name, count(*) AS count,
               (row_number() OVER (ORDER BY count(*) DESC, p_name) - 1)::DOUBLE AS name_index
        FROM part GROUP BY p_name""",
    "index_unseen": """
        WITH g AS (SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_brand END AS p_brand FROM part),
        i AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::DOUBLE AS n
              FROM g WHERE p_brand NOT LIKE '%5' GROUP BY p_brand)
        SELECT 'skip' AS mode, p_partkey, p_brand, n AS brand_index FROM g JOIN i USING (p_brand)
        UNION ALL SELECT 'error', p_partkey, p_brand, n FROM g JOIN i USING (p_brand)
        UNION ALL SELECT 'keep', p_partkey, p_brand, coalesce(n, (SELECT count(*) FROM i))
        FROM g LEFT JOIN i USING (p_brand)""",
    "scale_unseen": """
        WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi,
                          min(p_size) AS a, max(p_size) AS b FROM part WHERE p_size <= 30)
        SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 9) AS price_scaled,
               round(least(1, greatest(0, (p_size - a)::DOUBLE / (b - a))), 9) AS size_scaled
        FROM part, s""",
    "one_hot": """
        WITH i AS (SELECT p_type, (row_number() OVER (ORDER BY count(*) DESC, p_type) - 1)::INT
                          AS level FROM part GROUP BY p_type)
        SELECT p_partkey, i.level, (part.p_type = i.p_type)::INT::DOUBLE AS is_level
        FROM part CROSS JOIN i""",
    "one_hot_sparse": """
        WITH i AS (SELECT p_type, (row_number() OVER (ORDER BY count(*) DESC, p_type) - 1)::INT
                          AS level FROM part GROUP BY p_type)
        SELECT p_partkey, level FROM part JOIN i USING (p_type)""",
    "min_max": """
        WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
        SELECT p_partkey, p_retailprice, 7 AS same,
               round((p_retailprice - lo) / (hi - lo), 9) AS price_scaled, 0.5::DOUBLE AS same_scaled
        FROM part, s""",
    "training_frame": f"""{REVIEW_FRAME}
        SELECT * FROM f WHERE {draw("review_id")} < '{threshold(0.4)}'""",
    "exploratory_features": EXPLORATORY_FEATURES,
    "model_roundtrip": f"""{REVIEW_FRAME}
        SELECT count(*) AS rows, 0::BIGINT AS different FROM f
        WHERE {draw("review_id")} >= '{threshold(0.7)}'""",
}
