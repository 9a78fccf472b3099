"""The registered queries in plain SQL, to check results with another engine."""

from __future__ import annotations

LINEITEM_NUMBERS = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
}
LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
ORDERS = {
    "o_orderkey": ("bigint", "numeric"),
    "o_custkey": ("bigint", "numeric"),
    "o_orderstatus": ("string", "categorical"),
    "o_totalprice": ("double", "numeric"),
    "o_orderdate": ("timestamp_ntz", "temporal"),
    "o_orderpriority": ("string", "categorical"),
}
EVENTS = {
    "event_id": ("bigint", "numeric"),
    "ts": ("timestamp_ntz", "temporal"),
    "user_id": ("bigint", "numeric"),
    "event_type": ("string", "categorical"),
    "value": ("double", "numeric"),
    "props": ("string", "categorical"),
}


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def r(expression: str, digits: int) -> str:
    return f"round({expression}, {digits}) + 0.0"


# Profile


def schema_rows(table: str, columns: dict, extra: str) -> str:
    return union(
        f"SELECT {position} AS position, '{name}' AS name, '{dtype}' AS dtype, '{kind}' AS kind, "
        f"count(*) - count({name}) AS null_count, {extra.format(name=name)} FROM {table}"
        for position, (name, (dtype, kind)) in enumerate(columns.items())
    )


def numeric_stats() -> str:
    return union(
        f"SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"(count(*) - count({c})) / count(*)::DOUBLE AS null_fraction, "
        f"count(DISTINCT {c}) AS distinct_count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        f"{r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS stddev FROM lineitem"
        for c in LINEITEM_NUMBERS
    )


def quartile(column: str, p: float) -> str:
    return r(f"quantile_cont({column}::DOUBLE, {p})", 6)


def five_numbers() -> str:
    return union(
        f"SELECT '{c}' AS name, {r(f'min({c})::DOUBLE', 6)} AS min, {quartile(c, 0.25)} AS p25, "
        f"{quartile(c, 0.5)} AS p50, {quartile(c, 0.75)} AS p75, {r(f'max({c})::DOUBLE', 6)} AS max "
        f"FROM {table}"
        for table, columns in (("lineitem", LINEITEM_NUMBERS), ("part", PART_NUMBERS))
        for c in columns
    )


def iso(expression: str) -> str:
    return (
        f"CASE WHEN microsecond({expression}) % 1000000 = 0 "
        f"THEN strftime({expression}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({expression}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def temporal(table: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS name, {iso('low')} AS min_text, {iso('high')} AS max_text "
        f"FROM (SELECT min({column}) AS low, max({column}) AS high FROM {table})"
    )


def booleans() -> str:
    flags = (
        "(SELECT CASE WHEN toxic = 0 THEN quality = 1 END AS good, toxic = 1 AS toxic FROM labels)"
    )
    rows = union(
        f"SELECT '{c}' AS name, '{value}' AS value, count(*) FILTER (WHERE {condition}) AS count "
        f"FROM {flags}"
        for c in ("good", "toxic")
        for value, condition in (
            ("true", c),
            ("false", f"NOT {c}"),
            ("no data", f"{c} IS NULL"),
        )
    )
    return f"SELECT * FROM ({rows}) WHERE value <> 'no data' OR count > 0"


def histogram(table: str, column: str) -> str:
    return f"""
        SELECT '{column}' AS "column", b.bin::INTEGER AS bin,
               {r('low + b.bin * width', 6)} AS bin_start,
               {r('low + (b.bin + 1) * width', 6)} AS bin_end,
               count(x) AS count
        FROM (SELECT min({column})::DOUBLE AS low,
                     (max({column})::DOUBLE - min({column})::DOUBLE) / 20 AS width FROM {table}) edges
        CROSS JOIN range(20) b(bin)
        LEFT JOIN (SELECT {column}::DOUBLE AS x FROM {table}) rows
            ON b.bin = least(greatest(floor((x - low) / width), 0), 19)
        GROUP BY low, width, b.bin"""


def top(table: str, column: str) -> str:
    return f"""
        SELECT '{column}' AS "column", (row_number() OVER (ORDER BY n DESC, value))::INTEGER AS rank,
               value,
               n AS count
        FROM (SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL
              GROUP BY 1 ORDER BY n DESC, value LIMIT 10)"""


GAPS = """
    (SELECT l_orderkey,
            CASE WHEN l_linenumber <> 7 THEN l_quantity END AS l_quantity,
            CASE WHEN l_linenumber <> 7 AND l_tax > 0 THEN l_tax END AS l_tax,
            CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS l_returnflag
     FROM lineitem)"""


def missing() -> str:
    rows = union(
        f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, "
        f"{r(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 6)} AS percent FROM {GAPS}"
        for c in ("l_orderkey", "l_quantity", "l_tax", "l_returnflag")
    )
    return f"SELECT * FROM ({rows}) WHERE null_count > 0"


def correlations(relation: str, columns: list[str]) -> str:
    pairs = [
        f"SELECT '{a}' AS row_name, '{b}' AS column_name, "
        f"{r(f'corr({a}::DOUBLE, {b}::DOUBLE)', 8)} AS r FROM {relation}"
        for a in columns
        for b in columns
        if a != b
    ]
    ones = [f"SELECT '{c}' AS row_name, '{c}' AS column_name, 1.0::DOUBLE AS r" for c in columns]
    return union(pairs + ones)


# Split

NAMED = (
    "CASE WHEN rk <= cnt * {train} THEN 'train' WHEN rk <= cnt * {val} THEN 'val' "
    "ELSE 'test' END AS split"
)


def ranked(table: str, order: str, partition: str, train: str, val: str) -> str:
    return f"""
        (SELECT * EXCLUDE (rk, cnt), {NAMED.format(train=train, val=val)}
         FROM (SELECT *, row_number() OVER ({partition} ORDER BY {order}) AS rk,
                      count(*) OVER ({partition}) AS cnt FROM {table}))"""


def digest(column: str, seed: str = "42") -> str:
    return f"md5(CAST({column} AS VARCHAR) || '{seed}')"


RANDOM_ORDERS = ranked("orders", digest("o_orderkey"), "", "0.7", "0.9")
RANDOM_EVENTS = ranked("events", digest("event_id"), "", "0.7", "0.9")
RANDOM_DOCUMENTS = ranked("documents", digest("doc_id"), "", "0.7", "0.9")
STRATIFIED_ORDERS = ranked(
    "orders", digest("o_orderkey"), "PARTITION BY o_orderstatus", "0.7", "0.85"
)
MANY_STRATA = ranked("orders", digest("o_orderkey"), "PARTITION BY o_custkey", "0.6", "0.8")
TIMED_EVENTS = ranked("events", f"ts, {digest('event_id', '')}", "", "0.6", "0.8")
TIED_ORDERS = ranked("orders", f"o_orderdate, {digest('o_orderkey', '')}", "", "0.7", "0.85")
GROUPED_EVENTS = f"""
    (SELECT events.*, split
     FROM events JOIN (
         SELECT user_id, {NAMED.format(train="0.7", val="0.85")}
         FROM (SELECT user_id, sum(n) OVER (ORDER BY {digest('user_id')}) AS rk,
                      sum(n) OVER () AS cnt
               FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))
     ) assigned ON events.user_id IS NOT DISTINCT FROM assigned.user_id)"""


def exact_sizes(table: str, train: str, val: str, sums: dict[str, str]) -> str:
    """Sizes of the parts, and what the parts together must add up to."""
    cents = ", ".join(f"sum(round({e} * 100)::BIGINT)::BIGINT AS all_{name}" for name, e in sums.items())
    names = ", ".join(f"all_{name}" for name in sums)
    total = f"(SELECT count(*) AS n, {cents} FROM {table})"
    return (
        f"SELECT 'train' AS split, floor(n * {train})::BIGINT AS rows, {names} FROM {total} "
        f"UNION ALL SELECT 'val', (floor(n * {val}) - floor(n * {train}))::BIGINT, {names} FROM {total} "
        f"UNION ALL SELECT 'test', (n - floor(n * {val}))::BIGINT, {names} FROM {total}"
    )


MIXED = "(event_id * 7919 % 4001)"
LARGEST = str((1 << 63) - 1)
TIMES = {
    "decimal": MIXED,
    "text": f"{MIXED} % 40",
    "bigint": f"CASE WHEN {MIXED} % 2 = 0 THEN {LARGEST}::HUGEINT - {MIXED} ELSE {MIXED} - {LARGEST}::HUGEINT END",
    "interval": MIXED,
}


def split_by(seed: str) -> str:
    return ranked("orders", digest("o_orderkey", seed), "", "0.7", "0.85")


GAPPY_EVENTS = f"""
    gappy AS MATERIALIZED (
        SELECT event_id, user_id, split,
               CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value,
               event_id % 7 <> 0 AND event_id % 11 = 0 AS not_a_number,
               CASE WHEN event_id % 5 <> 0 THEN user_id % 97 END AS age,
               CASE WHEN event_id % 6 <> 0 THEN event_type END AS kind
        FROM {TIMED_EVENTS}),
    train AS (SELECT * FROM gappy WHERE split = 'train')"""


def filled_and_scaled() -> str:
    learned = """
        learned AS (
            SELECT avg(value) AS vm, avg(age) AS am, quantile_cont(value, 0.5) AS vq, quantile_cont(age, 0.5) AS aq,
                   min(age) AS lo, max(age) AS hi,
                   (SELECT kind FROM train WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) AS top
            FROM train),
        spread AS (
            SELECT stddev_samp(coalesce(value, vm)) AS vs, avg(coalesce(value, vm)) AS vc,
                   stddev_samp(coalesce(age, am)) AS sa, avg(coalesce(age, am)) AS ac,
                   quantile_cont(coalesce(age, aq), 0.5) AS q2,
                   quantile_cont(coalesce(age, aq), 0.75) - quantile_cont(coalesce(age, aq), 0.25) AS iqr
            FROM train, learned)"""
    return f"""
        WITH {GAPPY_EVENTS}, {learned}
        SELECT event_id, coalesce(kind, top) AS kind, {r('(coalesce(value, vm) - vc) / vs', 6)} AS value,
               {r('(coalesce(age, am) - ac) / sa', 6)} AS age, {r('coalesce(value, vq)', 6)} AS value2,
               {r('(coalesce(age, aq) - q2) / iqr', 6)} AS age2, {r('(age - lo) / (hi - lo)', 6)} AS age3
        FROM gappy, learned, spread WHERE split = 'test'"""


def encoded() -> str:
    """Out-of-fold means as leave-one-fold-out sums, for each row on its own."""
    def mean(column: str, taught: str) -> str:
        return f"""(SELECT (coalesce(sum(t.value) FILTER (t.{column} IS NOT DISTINCT FROM p.{column}), 0)
                            + 10 * avg(t.value)) / (count(t.value) FILTER (t.{column} IS NOT DISTINCT FROM p.{column}) + 10)
                    FROM taught t WHERE {taught})"""

    fold = "(('0x' || substr(md5('42|' || event_id::VARCHAR), 1, 13))::BIGINT % 5)"
    # One mean per category and fold, since that is all it depends on.
    means = union(
        f"""SELECT '{column}' AS c, p.{column}::VARCHAR AS k, f.fold,
                   {mean(column, 'f.fold < 0 OR t.fold <> f.fold')} AS m
            FROM (SELECT DISTINCT {column} FROM rows_) p, range(-1, 5) f(fold)"""
        for column in ("kind", "user_id")
    )
    return f"""
        WITH {GAPPY_EVENTS},
        rows_ AS MATERIALIZED (
            SELECT *, CASE WHEN split = 'train' THEN {fold} ELSE -1 END AS fold FROM gappy
            WHERE NOT not_a_number AND (split = 'train' OR split = 'test' AND event_id % 2 = 0)),
        taught AS MATERIALIZED (SELECT * FROM rows_ WHERE split = 'train' AND value IS NOT NULL),
        means AS MATERIALIZED ({means}),
        kinds AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS code,
                         row_number() OVER (ORDER BY count(*) DESC, kind) AS nth
                  FROM rows_ WHERE split = 'train' AND kind IS NOT NULL GROUP BY kind),
        users AS (SELECT user_id, row_number() OVER (ORDER BY user_id::VARCHAR) - 1 AS code
                  FROM (SELECT DISTINCT user_id FROM rows_ WHERE split = 'train'))
        SELECT split AS part, event_id,
               CASE WHEN rows_.kind IS NOT NULL THEN coalesce(kinds.code, -1) END AS place,
               coalesce(users.code, -1) AS "user",
               CASE WHEN rows_.kind IS NULL THEN '' WHEN nth <= 3 THEN 'kind=' || rows_.kind ELSE 'kind=*' END AS hot,
               {r('a.m', 6)} AS mean_kind, {r('b.m', 6)} AS mean_user
        FROM rows_ LEFT JOIN kinds USING (kind) LEFT JOIN users USING (user_id)
        JOIN means a ON a.c = 'kind' AND a.k IS NOT DISTINCT FROM rows_.kind AND a.fold = rows_.fold
        JOIN means b ON b.c = 'user_id' AND b.k = rows_.user_id::VARCHAR AND b.fold = rows_.fold"""


def spearman(table: str, columns: list[str]) -> str:
    """Average ranks within the common rows of each pair: those below, and half of those equal."""
    def pair(a: str, b: str) -> str:
        def rank(c: str) -> str:
            return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"

        common = f"(SELECT {a}, {b} FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        return f"SELECT '{a}' AS row_name, '{b}' AS column_name, corr({a}, {b}) AS v FROM (SELECT {rank(a)}, {rank(b)} FROM {common})"

    upper = union(pair(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :])
    ones = union(f"SELECT '{c}' AS row_name, '{c}' AS column_name, 1.0 AS v" for c in columns)
    return f"""
        WITH upper_ AS ({upper})
        SELECT row_name, column_name, {r('v', 8)} AS r FROM (
            SELECT * FROM upper_ UNION ALL SELECT column_name, row_name, v FROM upper_ UNION ALL {ones})"""


def mixed_associations() -> str:
    quarter = " + ".join(f"(o_totalprice > (SELECT quantile_cont(o_totalprice, {q}) FROM orders))::INTEGER" for q in (0.25, 0.5, 0.75))
    columns = {
        "o_orderstatus": "o_orderstatus",
        "o_orderpriority": "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END",
        "year": "year(o_orderdate)",
        "o_totalprice": quarter,
        "third": "o_custkey % 10 = 3",
        "o_custkey": "o_custkey",
    }
    names = list(columns)
    chosen = ", ".join(f"({e})::VARCHAR AS {c}" for c, e in columns.items())

    def pair(a: str, b: str) -> str:
        return f"""
            SELECT '{a}' AS row_name, '{b}' AS column_name, sum(n)::BIGINT AS rows,
                   {r('sqrt(greatest(sum(n * n / (na * nb)) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1))', 8)} AS cramers_v,
                   {r('greatest(sum(n / t * ln(n * t / (na * nb))), 0)', 8)} AS mutual_information
            FROM (SELECT *, sum(n) OVER (PARTITION BY a)::DOUBLE AS na, sum(n) OVER (PARTITION BY b)::DOUBLE AS nb,
                         sum(n) OVER ()::DOUBLE AS t
                  FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM coded
                        WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))"""

    pairs = union(f"({pair(a, b)})" for i, a in enumerate(names) for b in names[i + 1 :])
    return f"WITH coded AS MATERIALIZED (SELECT {chosen} FROM orders) {pairs}"


def fences() -> str:
    columns = {
        "l_quantity": "l_quantity",
        "price": "CASE WHEN l_orderkey % 53 = 0 THEN l_extendedprice * 9 ELSE l_extendedprice END",
        "tax": "CASE WHEN l_linenumber <> 7 THEN l_tax * l_tax END",
        "discount": "trunc(l_discount * 100)",
    }
    return union(
        f"""
        (WITH v AS (SELECT ({e})::DOUBLE AS x FROM lineitem),
              q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM v),
              m AS (SELECT quantile_cont(abs(x - b), 0.5) AS mad FROM v, q WHERE x IS NOT NULL)
         SELECT '{name}' AS name, count(x) AS filled, {r('any_value(a)', 6)} AS p25, {r('any_value(b)', 6)} AS p50,
                {r('any_value(c)', 6)} AS p75, {r('any_value(a - 1.5 * (c - a))', 6)} AS low_fence,
                {r('any_value(c + 1.5 * (c - a))', 6)} AS high_fence, {r('any_value(mad)', 6)} AS mad,
                count(*) FILTER (x < a - 1.5 * (c - a)) AS below, count(*) FILTER (x > c + 1.5 * (c - a)) AS above,
                count(*) FILTER (abs(x - b) > 3.5 * 1.4826 * mad) AS far
         FROM v, q, m)"""
        for name, e in columns.items()
    )


def rules() -> str:
    conditions = [
        "l_shipdate IS NULL",
        "l_discount < 0.02 OR l_discount > 0.08",
        "l_quantity < 1",
        "l_returnflag NOT IN ('A', 'N')",
        "l_linestatus <> 'O'",
        "NOT l_extendedprice >= 1000 * l_tax * l_quantity",
        "(l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
        "(l_orderkey, l_partkey, l_suppkey) IN (SELECT (l_orderkey, l_partkey, l_suppkey) FROM lineitem "
        "GROUP BY l_orderkey, l_partkey, l_suppkey HAVING count(*) > 1)",
        "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
        "l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    ]
    return union(
        f"SELECT {i} AS position, count(*) AS rows, count(*) FILTER ({c}) AS failing, count(*) FILTER ({c}) = 0 AS passed FROM lineitem"
        for i, c in enumerate(conditions)
    )


def two_slopes() -> str:
    """Least squares of two features in closed form, from variances and covariances."""
    return f"""
        WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_tax AS b FROM lineitem WHERE l_linenumber <> 7),
        s AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab, covar_samp(a, y) AS ay, covar_samp(b, y) AS yb,
                     avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM d),
        w AS (SELECT *, (ay * vb - yb * ab) / (va * vb - ab * ab) AS wa, (yb * va - ay * ab) / (va * vb - ab * ab) AS wb FROM s)
        SELECT 0 AS position, NULL AS feature, {r('my - wa * ma - wb * mb', 3)} AS coefficient FROM w
        UNION ALL SELECT 1, 'l_quantity', {r('wa', 3)} FROM w UNION ALL SELECT 2, 'l_tax', {r('wb', 3)} FROM w"""


# Two features of 0 and 1 and their product: the likeliest odds are those found in the four cells.
CELLS = """
    d AS (SELECT (l_returnflag = 'R')::INTEGER AS y, l_linenumber <= 3 AS e, l_quantity > 20 AS g, l_orderkey % 2 AS odd FROM lineitem),
    p AS (SELECT e, g, avg(y) AS p, ln(avg(y) / (1 - avg(y))) AS z FROM d WHERE odd = 1 GROUP BY e, g),
    z AS (SELECT max(z) FILTER (NOT e AND NOT g) AS z00, max(z) FILTER (e AND NOT g) AS z10,
                 max(z) FILTER (NOT e AND g) AS z01, max(z) FILTER (e AND g) AS z11 FROM p)"""


def quality() -> str:
    return f"""
        WITH {CELLS},
        s AS (SELECT y, p AS v FROM d JOIN p USING (e, g) WHERE odd = 0),
        k AS (SELECT y, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM s),
        t AS (SELECT count(*) AS n, sum(y)::DOUBLE AS pos, sum(rk) FILTER (y = 1) AS ranks FROM k)
        SELECT n AS rows, pos::BIGINT AS positives, {r('(ranks - pos * (pos + 1) / 2) / pos / (n - pos)', 8)} AS auc,
               {r('(SELECT avg((v - y) * (v - y)) FROM s)', 8)} AS brier,
               {r('(SELECT -avg(CASE WHEN y = 1 THEN ln(v) ELSE ln(1 - v) END) FROM s)', 8)} AS log_loss
        FROM t"""


def wide_profile() -> str:
    return union(
        f"SELECT 'v{i:03d}' AS name, count(*) AS row_count, 0::BIGINT AS null_count, min(v) AS min, max(v) AS max, "
        f"{r('avg(v)', 6)} AS mean FROM (SELECT l_quantity * {i % 50 + 1} + l_linenumber * {i} AS v FROM lineitem)"
        for i in range(250)
    )


def wide_audit() -> str:
    """The target's copy is linear in it; whether another column is, is worked out here, too."""
    hashes = {f"c{i:03d}": f"(o_orderkey * {2 * i + 3} % 97)" for i in range(128)}
    hashes |= {"score_final": "(o_custkey % 89)", "again": "o_totalprice"}
    train = f"(SELECT * FROM orders WHERE {hashes['c000']} < 60)"
    signals = union(
        f"SELECT {i} AS place, '{name}' AS name, "
        f"abs(corr({e}::DOUBLE, o_totalprice)) BETWEEN 0.98 AND 1.01 AS linear FROM {train}"
        for i, (name, e) in enumerate(hashes.items())
    )
    pure = union(
        f"SELECT {i} AS place, '{name}' AS name, count(*) AS vals, "
        f"sum(CASE WHEN low = high THEN n ELSE 0 END) / sum(n) AS purity, sum(n) AS n "
        f"FROM (SELECT {e} AS v, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM {train} GROUP BY 1)"
        for i, (name, e) in enumerate(hashes.items())
    )
    return f"""
        SELECT 'target_proxy' AS "check", CASE WHEN count(*) > 0 THEN 'critical' ELSE 'info' END AS severity,
               coalesce(string_agg(name, ',' ORDER BY place), '') AS columns
        FROM ({signals}) JOIN ({pure}) USING (place, name)
        WHERE linear OR (vals <= 0.5 * n AND purity >= 0.99)
        UNION ALL SELECT 'post_outcome_names', 'warning', 'score_final'"""


def summary_rows() -> str:
    parts = []
    for name, (_, kind) in EVENTS.items():
        histogram = f"count({name})" if kind == "numeric" else "NULL::BIGINT"
        tops = (
            f"(SELECT max(n) FROM (SELECT count(*) AS n FROM events WHERE {name} IS NOT NULL GROUP BY {name}))"
            if kind == "categorical"
            else "NULL::BIGINT"
        )
        parts.append(
            f"SELECT '{name}' AS name, '{kind}' AS kind, count(*) AS row_count, "
            f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count, "
            f"{histogram} AS in_histogram, {tops} AS top_count FROM events"
        )
    return union(parts)


CLUSTERED = """
    (SELECT CASE WHEN l_linenumber > 4 THEN l_quantity + 1e7 ELSE l_tax END AS x,
            CASE WHEN l_linenumber > 4 THEN l_quantity * 3 - 2 END AS y,
            CASE WHEN l_linenumber > 4 THEN l_quantity + l_discount * 100 END AS z FROM lineitem)"""


def clustered() -> str:
    """Pearson's r about the means of the common rows, from its definition."""
    pairs = union(
        f"SELECT '{a}' AS row_name, '{b}' AS column_name, "
        f"{r('sum((p - mp) * (q - mq)) / sqrt(sum((p - mp) ** 2) * sum((q - mq) ** 2))', 6)} AS r "
        f"FROM (SELECT {a} AS p, {b} AS q, avg({a}) OVER () AS mp, avg({b}) OVER () AS mq "
        f"FROM {CLUSTERED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a in "xyz"
        for b in "xyz"
        if a != b
    )
    ones = union(f"SELECT '{c}' AS row_name, '{c}' AS column_name, 1.0::DOUBLE AS r" for c in "xyz")
    return union([pairs, ones])


ORDER_COLUMNS = list(ORDERS)
RANDOM_6 = ranked("events", digest("event_id"), "", "0.6", "0.8")


# Audit


def proxies(relation: str, numeric: list[str], other: list[str], target_numeric: bool) -> str:
    """One suspicious column per row, after the definitions of the three signals."""
    measured = []
    for position, f in enumerate([*numeric, *other]):
        is_number = f in numeric
        linear = (
            f"(SELECT abs(corr({f}::DOUBLE, target::DOUBLE)) FROM t)"
            if is_number and target_numeric
            else "NULL::DOUBLE"
        )
        separates = (
            f"""(SELECT count(*) >= 2 AND bool_and(previous IS NULL OR previous < low)
                 FROM (SELECT low, lag(high) OVER (ORDER BY low, high) AS previous
                       FROM (SELECT min({f})::DOUBLE AS low, max({f})::DOUBLE AS high FROM t
                             WHERE {f} IS NOT NULL AND target IS NOT NULL GROUP BY target)))"""
            if is_number
            else "FALSE"
        )
        measured.append(
            f"""SELECT {position} AS position, '{f}' AS "column", {linear} AS r,
                       {separates} AS separates,
                       (SELECT count(DISTINCT {f}) FROM t) AS distinct_values,
                       (SELECT sum(CASE WHEN targets = 1 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE
                        FROM (SELECT count(*) AS n, count(DISTINCT target) AS targets FROM t
                              WHERE {f} IS NOT NULL GROUP BY {f})) AS purity"""
        )
    return f"""
        WITH t AS (SELECT * FROM {relation}),
        sizes AS (SELECT count(*) AS n, count(DISTINCT target) AS classes FROM t),
        measured AS ({union(measured)}),
        named AS (
            SELECT "column", r, purity, position,
                   CASE WHEN NOT isnan(r) AND r >= 0.98 THEN 'correlation'
                        WHEN separates AND classes BETWEEN 2 AND 10 THEN 'threshold_separation'
                        WHEN distinct_values BETWEEN 1 AND n * 0.5 AND purity >= 0.99
                        THEN 'functional_dependency' END AS signal
            FROM measured, sizes)
        SELECT position, "column", signal,
               CASE signal WHEN 'correlation' THEN round(r, 4)
                           WHEN 'threshold_separation' THEN 1.0::DOUBLE
                           ELSE round(purity, 4) END AS value
        FROM named WHERE signal IS NOT NULL"""


def bare(sql: str) -> str:
    return f'SELECT "column", signal, value FROM ({sql})'


LINEAR = """
    (SELECT l_quantity AS target, l_quantity * 3 + 1 AS copy, l_quantity + l_tax AS noisy,
            l_extendedprice, l_discount, l_partkey, l_returnflag FROM lineitem)"""
THRESHOLD = """
    (SELECT (l_quantity > 25)::INTEGER AS target, l_quantity, l_extendedprice, l_tax,
            CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size, l_returnflag
     FROM lineitem)"""
DEPENDENT = """
    (SELECT o_orderstatus AS target, 's' || o_orderstatus AS code,
            CASE WHEN o_orderpriority <> '5-LOW' THEN lower(o_orderstatus) END AS gaps,
            CASE WHEN o_orderstatus = 'O' AND o_totalprice < 1500 THEN 'x' ELSE o_orderstatus END
                || o_orderpriority AS mixed,
            o_orderpriority, o_orderkey, o_custkey FROM orders)"""


def class_ranges() -> str:
    return union(
        f"""SELECT '{c}' AS "column", l_returnflag AS class, min({c})::DOUBLE AS low,
                   max({c})::DOUBLE AS high FROM lineitem GROUP BY l_returnflag"""
        for c in LINEITEM_NUMBERS
    )


def value_purities() -> str:
    return union(
        f"""SELECT '{c}' AS "column", count(*) AS values,
                   {r('sum(CASE WHEN targets = 1 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE', 6)}
                   AS purity
            FROM (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS targets FROM lineitem
                  WHERE {c} IS NOT NULL GROUP BY {c})"""
        for c in LINEITEM
        if c != "l_returnflag"
    )


def shared(relation: str, columns: str) -> str:
    return f"""
        (SELECT count(*) AS n FROM (
            SELECT {columns} FROM {relation} WHERE split = 'train'
            INTERSECT SELECT {columns} FROM {relation} WHERE split = 'test'))"""


NOISY = "event_type, value + user_id / 1e9::DOUBLE AS value"
NOISY_ROUNDED = "event_type, round(value + user_id / 1e9::DOUBLE, 3) AS value"


def time_edges(relation: str, strategy: str, severity: str) -> str:
    return f"""
        SELECT '{strategy}' AS strategy,
               CASE WHEN high <= low THEN 'info' ELSE '{severity}' END AS severity,
               CAST(high AS VARCHAR) AS max_train, CAST(low AS VARCHAR) AS min_test
        FROM (SELECT max(ts) FILTER (WHERE split = 'train') AS high,
                     min(ts) FILTER (WHERE split = 'test') AS low FROM {relation})"""


AUDITED = f"""
    (SELECT event_id, ts, user_id, event_type AS target, value AS value_final, props,
            upper(event_type) AS label FROM {RANDOM_EVENTS} WHERE split = 'train')"""


def audit_report() -> str:
    found = proxies(
        AUDITED, ["event_id", "user_id", "value_final"], ["ts", "props", "label"], False
    )
    # Ranks of the columns in the audited frame.
    order = "event_id,ts,user_id,value_final,props,label".split(",")
    rank = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order))
    rows = shared(RANDOM_EVENTS, "event_id, ts, user_id, event_type, value, props")
    near = shared(RANDOM_EVENTS, "event_id, ts, user_id, event_type, round(value, 3), props")
    groups = shared(RANDOM_EVENTS, "user_id")
    return f"""
        SELECT 0 AS position, 'target_proxy' AS "check",
               CASE WHEN count(*) > 0 THEN 'critical' ELSE 'info' END AS severity,
               coalesce(string_agg("column", ',' ORDER BY CASE "column" {rank} END), '') AS columns
        FROM ({found})
        UNION ALL SELECT 1, 'row_overlap', CASE WHEN n > 0 THEN 'critical' ELSE 'info' END, ''
        FROM {rows}
        UNION ALL SELECT 2, 'near_duplicates',
               CASE WHEN a.n > e.n THEN 'warning' ELSE 'info' END, '' FROM {near} a, {rows} e
        UNION ALL SELECT 3, 'temporal_leak', severity, 'ts'
        FROM ({time_edges(RANDOM_EVENTS, 'random', 'warning')})
        UNION ALL SELECT 4, 'group_leak', CASE WHEN n > 0 THEN 'critical' ELSE 'info' END, 'user_id'
        FROM {groups}
        UNION ALL SELECT 5, 'pipeline_contamination', 'info', ''
        UNION ALL SELECT 6, 'post_outcome_names', 'warning', 'value_final'"""


def csv_stats() -> str:
    dates = {**ORDERS, "o_orderdate": ("date", "temporal")}
    parts = []
    for position, (name, (dtype, kind)) in enumerate(dates.items()):
        mean = r(f"avg({name})", 4) if kind == "numeric" else "NULL::DOUBLE"
        parts.append(
            f"SELECT {position} AS position, '{name}' AS name, '{dtype}' AS dtype, "
            f"'{kind}' AS kind, count(*) AS row_count, count(*) - count({name}) AS null_count, "
            f"count(DISTINCT {name}) AS distinct_count, {mean} AS mean FROM orders"
        )
    return union(parts)


ORACLES = {
    "schema_nulls": schema_rows("orders", ORDERS, "count(*) AS row_count"),
    "column_stats_numeric": numeric_stats(),
    "column_stats_of_every_kind": schema_rows(
        "events", EVENTS, "count(DISTINCT {name}) AS distinct_count"
    ),
    "profile_overview": f"""
        SELECT count(*) AS row_count, {len(LINEITEM)} AS column_count,
               TRUE AS distinct_exact, FALSE AS truncated_columns,
               TRUE AS truncated_histograms, FALSE AS truncated_top_values,
               FALSE AS truncated_correlations FROM lineitem""",
    "distinct_estimates": union(
        f"SELECT '{c}' AS name, count(DISTINCT {c}) AS distinct_count, TRUE AS close FROM lineitem"
        for c in LINEITEM
    ),
    "quartiles": five_numbers(),
    "quartiles_by_narrowing": union(
        f"SELECT '{c}' AS name, {quartile(c, 0.25)} AS p25, {quartile(c, 0.5)} AS p50, "
        f"{quartile(c, 0.75)} AS p75 FROM lineitem"
        for c in LINEITEM_NUMBERS
    ),
    "temporal_range": union([temporal("orders", "o_orderdate"), temporal("events", "ts")]),
    "boolean_counts": booleans(),
    "histograms": union(
        histogram(table, c)
        for table, columns in (("lineitem", LINEITEM_NUMBERS), ("customer", CUSTOMER_NUMBERS))
        for c in columns
    ),
    "top_values": union(
        top(table, c)
        for table, columns in (
            ("orders", ["o_orderstatus", "o_orderpriority"]),
            ("events", ["event_type", "props"]),
        )
        for c in columns
    ),
    "missing_values": missing(),
    "correlation_long": correlations("lineitem", list(LINEITEM_NUMBERS)),
    "correlation_with_gaps": correlations(GAPS, ["l_orderkey", "l_quantity", "l_tax"]),
    "correlation_with_target": union(
        f"""SELECT '{c}' AS "column", {r(f'corr({c}::DOUBLE, l_quantity)', 8)} AS r FROM lineitem"""
        for c in LINEITEM_NUMBERS
        if c != "l_quantity"
    ),
    "split_random": f"SELECT o_orderkey, split FROM {RANDOM_ORDERS}",
    "split_stratified": f"SELECT o_orderkey, split FROM {STRATIFIED_ORDERS}",
    "split_many_strata": f"SELECT o_orderkey, split FROM {MANY_STRATA}",
    "split_time": f"SELECT event_id, split FROM {TIMED_EVENTS}",
    "split_time_with_ties": f"SELECT o_orderkey, split FROM {TIED_ORDERS}",
    "split_group": f"SELECT event_id, split FROM {GROUPED_EVENTS}",
    "split_sizes": f"""
        SELECT split, count(*) AS rows,
               {r('count(*) / (SELECT count(*) FROM orders)::DOUBLE', 6)} AS share
        FROM {RANDOM_ORDERS} GROUP BY split""",
    "split_sizes_of_files": exact_sizes("lineitem", "0.7", "0.85", {c: c for c in LINEITEM_NUMBERS}),
    "split_sizes_of_copies": exact_sizes(
        "lineitem", "0.7", "0.85", {"l_discount": "round(l_discount * 100)::INTEGER"}
    ),
    **{
        f"split_time_by_{name}": "SELECT event_id, split FROM "
        + ranked("events", f"{order}, {digest('event_id', '')}", "", "0.6", "0.8")
        for name, order in TIMES.items()
    },
    "split_seeds": f"""
        SELECT count(*) AS rows, count(*) AS same_seed, count(*) FILTER (WHERE a.split = b.split) AS other_seed
        FROM {split_by("7")} a JOIN {split_by("8")} b USING (o_orderkey)""",
    "split_columns": union(
        f"SELECT '{split}' AS split, '{c}' AS \"column\"" for split in ("train", "val", "test") for c in ORDER_COLUMNS
    ),
    "split_refusals": """
        SELECT * FROM (VALUES ('shares', 1::INTEGER, NULL::BIGINT), ('empty train', 1, NULL), ('no column', 1, NULL),
                              ('unknown column', 1, NULL), ('everything', 5, NULL)) refused(plan, faults, rows)
        UNION ALL SELECT 'fine', 0, count(*) FROM orders""",
    "audit_wide": wide_audit(),
    "row_overlap_widened": """
        SELECT count(DISTINCT (o_orderkey, o_custkey, o_orderdate::DATE, o_orderstatus)) AS shared_rows,
               count(DISTINCT o_custkey) AS shared_groups
        FROM orders WHERE o_orderkey % 3 = 0""",
    "audit_severities": "SELECT * FROM (VALUES ('time_based', 'info'), ('random', 'warning'), ('group', 'warning')) t(strategy, severity)",
    "csv_semicolon_cycle": f"""
        SELECT split, count(*) AS rows, sum(o_orderkey)::BIGINT AS sum_keys, 6 AS columns,
               (SELECT count(*) FROM orders) AS profiled_rows
        FROM {RANDOM_ORDERS} GROUP BY split""",
    "catalog_walk": """
        SELECT 'dataset' AS part, '6 orders' AS name, count(*) AS value FROM orders
        UNION ALL SELECT 'dataset', '7 events', count(*) FROM events
        UNION ALL SELECT 'profile', 'profiles of events', 2
        UNION ALL SELECT 'profile', 'latest is the last', 1
        UNION ALL SELECT 'profile', 'rows of orders', count(*) FROM orders
        UNION ALL SELECT 'split', 'random', floor(count(*) * 0.6)::BIGINT FROM events
        UNION ALL SELECT 'split', 'newest first', 1
        UNION ALL SELECT 'report', 'random critical', 1
        UNION ALL SELECT 'report', 'group warning', 1
        UNION ALL SELECT 'lineage', 'events · test', 0
        UNION ALL SELECT 'lineage', 'events', 1""",
    "outlier_fences": fences(),
    "quality_rules": rules(),
    "baseline_linear": two_slopes(),
    "baseline_logistic": f"""
        WITH {CELLS}
        SELECT 0 AS position, NULL AS feature, {r('z00', 6)} AS coefficient FROM z
        UNION ALL SELECT 1, 'early', {r('z10 - z00', 6)} FROM z UNION ALL SELECT 2, 'large', {r('z01 - z00', 6)} FROM z
        UNION ALL SELECT 3, 'both', {r('z11 - z10 - z01 + z00', 6)} FROM z""",
    "baseline_quality": quality(),
    "baseline_calibration": f"""
        SELECT least(floor(v * 7), 6)::INTEGER AS bin, count(*) AS rows, {r('avg(v)', 6)} AS mean_score, {r('avg(y)', 6)} AS positive_rate
        FROM (SELECT (l_discount * 700 + l_tax * 300) / 97 AS v, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)
        WHERE v BETWEEN 0 AND 1 GROUP BY 1""",
    "spearman_long": spearman("lineitem", list(LINEITEM_NUMBERS)),
    "spearman_with_gaps": spearman(GAPS, ["l_orderkey", "l_quantity", "l_tax"]),
    "associations_mixed": mixed_associations(),
    "features_imputed_scaled": filled_and_scaled(),
    "features_encoded": encoded(),
    "pipeline_contamination": f"""
        SELECT 'none' AS state, 0 AS versions, 'info' AS severity, '' AS columns, 0 AS steps
        UNION ALL SELECT 'train', 1, 'info', '', 0
        UNION ALL SELECT 'all', 2, 'critical', 'value,event_type', 3
        UNION ALL SELECT 'test', 3, 'critical', 'value,event_type', 3
        UNION ALL SELECT 'train again', 4, 'info', '', 0
        UNION ALL SELECT 'rows of test', count(*), 'features', '', 0 FROM {GROUPED_EVENTS} WHERE split = 'test'""",
    "formats_and_refusals": """
        SELECT 'a.PQ' AS name, 'parquet' AS format, count(*) AS rows FROM orders
        UNION ALL SELECT 'b.xlsx', NULL, NULL
        UNION ALL SELECT 'c.Csv', 'csv', count(*) FROM orders
        UNION ALL SELECT 'd.parquet', 'parquet', NULL
        UNION ALL SELECT 'missing.csv', 'csv', NULL""",
    "json_scalars": f"""
        SELECT o_orderkey, {iso("o_orderdate")} AS o_orderdate, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day,
               CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS price,
               lower(hex(encode(o_orderpriority))) AS raw
        FROM orders""",
    "summary_document": summary_rows(),
    "profile_wide": wide_profile(),
    "distinct_exact_large": union(
        f"SELECT '{name}' AS name, count(DISTINCT {e}) AS distinct_count, TRUE AS distinct_exact "
        "FROM lineitem CROSS JOIN range(20) c(copy)"
        for name, e in (
            ("order_copy", "l_orderkey * 20 + copy"),
            ("shifted", "l_partkey + copy"),
            ("price", "l_extendedprice * (copy % 3)"),
        )
    ),
    "correlation_clustered_gaps": clustered(),
    "split_written": f"""
        SELECT split, o_orderstatus, count(*) AS rows, sum(o_orderkey)::BIGINT AS sum_keys
        FROM {STRATIFIED_ORDERS} GROUP BY ALL""",
    "proxy_correlation": bare(
        proxies(
            LINEAR,
            ["copy", "noisy", "l_extendedprice", "l_discount", "l_partkey"],
            ["l_returnflag"],
            True,
        )
    ),
    "proxy_separation": bare(
        proxies(
            THRESHOLD, ["l_quantity", "l_extendedprice", "l_tax"], ["size", "l_returnflag"], True
        )
    ),
    "proxy_dependency": bare(
        proxies(
            DEPENDENT,
            ["o_orderkey", "o_custkey"],
            ["code", "gaps", "mixed", "o_orderpriority"],
            False,
        )
    ),
    "ranges_by_class": class_ranges(),
    "value_purities": value_purities(),
    "row_overlap": f"""
        SELECT n AS shared_rows FROM {shared(RANDOM_DOCUMENTS, 'text, lang')}""",
    "near_duplicates": f"""
        SELECT e.n AS exact_duplicates, greatest(a.n - e.n, 0) AS near_duplicates
        FROM {shared(RANDOM_EVENTS, NOISY)} e, {shared(RANDOM_EVENTS, NOISY_ROUNDED)} a""",
    "similar_orders": f"""
        WITH rows AS (
            SELECT p.o_orderkey, p.split, o.o_totalprice / 2000.0 AS x, datediff('day', DATE '1970-01-01', o.o_orderdate) / 20.0 AS y,
                   o.o_orderstatus AS s, o.o_orderpriority AS q
            FROM {RANDOM_ORDERS} p JOIN orders o USING (o_orderkey)),
        pairs AS (
            SELECT a.o_orderkey, (a.s <> b.s)::INT + (a.q <> b.q)::INT AS apart
            FROM rows a JOIN rows b ON b.split = 'train' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1
            WHERE a.split = 'test')
        SELECT r.o_orderkey, coalesce(min(apart) <= 1, false) AS loose, coalesce(min(apart) = 0, false) AS strict
        FROM rows r LEFT JOIN pairs USING (o_orderkey) WHERE r.split = 'test' GROUP BY r.o_orderkey""",
    "temporal_leak": union(
        [
            time_edges(TIMED_EVENTS, "time_based", "critical"),
            time_edges(RANDOM_EVENTS, "random", "warning"),
        ]
    ),
    "group_leak": f"""
        SELECT 'group' AS strategy, n AS shared_groups FROM {shared(GROUPED_EVENTS, 'user_id')}
        UNION ALL SELECT 'random', n FROM {shared(RANDOM_EVENTS, 'user_id')}""",
    "audit_report": audit_report(),
    "csv_stats": csv_stats(),
    "catalog_children": f"""
        SELECT 'events · ' || split AS name, count(*) AS rows, 'parquet' AS format, split,
               count(*) AS recorded
        FROM {GROUPED_EVENTS} GROUP BY split""",
}
