"""DuckDB SQL of the quality rules: the same estimates, with every concentration step written out.

The query stops when no estimate moves; further steps then change nothing, so the SQL makes them all.
"""

from __future__ import annotations

from .quality_outliers import BUCKETS, LEAST_ROWS, MEASURES, MOST_STEPS, PAIRS, SCALE, SPREAD, SUBSET, TAIL, TRIAL_STEPS, P, X, chi_square

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
XS = ", ".join(X)
LINE = ", ".join([*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS), "size"])
SUMS = ", ".join(["count(*) AS n", *(f"sum({x})::BIGINT AS s{i}" for i, x in enumerate(X)), *(f"sum({X[i]} * {X[j]})::BIGINT AS q{i}{j}" for i, j in PAIRS)])
BUCKET = f"floor({BUCKETS} * (ln(greatest(d2, 1e-6::DOUBLE)) / ln(2::DOUBLE)))::INT"
NUMBER = lambda x: f"{x!r}::DOUBLE"


def total(terms: list[str]) -> str:
    return "(" + " + ".join(["0::DOUBLE", *terms]) + ")"


def steps(source: str, columns: list[tuple[str, str]]) -> str:
    """Columns added one after another, each seeing those before it."""
    for name, e in columns:
        source = f"(SELECT *, {e} AS {name} FROM {source})"
    return source


def factored(source: str) -> str:
    """c00.. -> l00.. and size."""
    columns = []
    for j in range(P):
        rest = lambda i, j=j: f"(c{i}{j} - {total([f'l{i}{k} * l{j}{k}' for k in range(j)])})"
        columns += [(f"l{j}{j}", f"sqrt(greatest({rest(j)}, 1e-6::DOUBLE))"), *((f"l{i}{j}", f"{rest(i)} / l{j}{j}") for i in range(j + 1, P))]
    return steps(source, [*columns, ("size", total([f"2 * ln(l{j}{j})" for j in range(P)]))])


def estimated(source: str) -> str:
    mean = [(f"m{i}", f"s{i} / n") for i in range(P)]
    return factored(steps(source, mean + [(f"c{i}{j}", f"q{i}{j} / n - m{i} * m{j} + {NUMBER((SPREAD[i] * SCALE) ** 2 if i == j else 0.0)}") for i, j in PAIRS]))


def distance(source: str) -> str:
    z = [(f"z{i}", f"({X[i]} - m{i} - {total([f'l{i}{k} * z{k}' for k in range(i)])}) / l{i}{i}") for i in range(P)]
    return steps(source, [*z, ("d2", total([f"z{i} * z{i}" for i in range(P)]))])


def reached(source: str, by: str, a: int, b: int, name: str) -> str:
    counts = f"(SELECT {by}, {BUCKET} AS b, count(*) AS n FROM {source} GROUP BY ALL)"
    upto = f"(SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}) AS whole FROM {counts})"
    return f"(SELECT {by}, min(b) AS {name} FROM {upto} WHERE upto * {b} >= whole * {a} GROUP BY {by})"


def quality() -> str:
    share = lambda a, b: f"sqrt({a}::DOUBLE / greatest({b}, 1))"
    x = ["ln(n_words + 1::DOUBLE)", "ln(greatest(word_chars, 1)::DOUBLE / greatest(n_words, 1))", share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    vector = ", ".join(f"round({SCALE} * {e})::BIGINT AS {n}" for e, n in zip(x, X, strict=True))
    sd = "[" + ", ".join(NUMBER(s * SCALE) for s in SPREAD) + "]"
    cov = lambda i, j: f"(b{i}{j} / n - a{i} / n * (a{j} / n))"
    first = {
        0: lambda i, j: "1::DOUBLE" if i == j else "0::DOUBLE",
        1: lambda i, j: "1::DOUBLE" if i == j else f"{cov(i, j)} / sqrt(v{i} * v{j})",
        2: lambda i, j: f"(e{i}{j} / n * {NUMBER(P / 1024**2)} + {'0.01' if i == j else '0'}::DOUBLE)",
    }
    cte = [
        f"t AS (SELECT row_number() OVER () AS r, doc_id, lang AS l, source AS s, coalesce(text, '') AS t, list_filter(string_split(translate(coalesce(text, ''), {BLANK}, '      '), ' '), lambda x: x <> '') AS w FROM documents)",
        f"u AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(translate(x, {BLANK}, '      ')) <> '') AS lines FROM t)",
        "win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t))",
        "rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r)",
        "m0 AS (SELECT r, doc_id, l, s, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM u LEFT JOIN rep USING (r))",
        "m AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0)",
        f"v AS (SELECT l, s, {vector} FROM (SELECT DISTINCT l, s, n_lines, {', '.join(MEASURES)} FROM m WHERE NOT base_failed))",
        f"sz AS (SELECT *, sum(CASE WHEN n < {LEAST_ROWS} THEN n ELSE 0 END) OVER (PARTITION BY l) AS pooled FROM (SELECT l, s, count(*) AS n FROM v GROUP BY ALL))",
        f"gs AS MATERIALIZED (SELECT l, s, CASE WHEN n >= {LEAST_ROWS} THEN coalesce(l, chr(1)) || chr(2) || coalesce(s, chr(1)) WHEN pooled >= {LEAST_ROWS} THEN coalesce(l, chr(1)) ELSE '' END AS grp FROM sz)",
        f"g AS MATERIALIZED (SELECT grp, {XS} FROM v JOIN gs ON v.l IS NOT DISTINCT FROM gs.l AND v.s IS NOT DISTINCT FROM gs.s)",
        f"lo AS (SELECT grp, i, x, count(*) AS n FROM (SELECT grp, unnest([{XS}]) AS x, unnest(range(0, {P})) AS i FROM g) GROUP BY ALL)",
        "la AS (SELECT *, sum(n) OVER (PARTITION BY grp, i ORDER BY x) AS upto, sum(n) OVER (PARTITION BY grp, i) AS whole FROM lo)",
        f"quart AS (SELECT grp, i, at2, greatest((at3 - at1) / 1.349::DOUBLE, {sd}[i + 1]) AS sd FROM (SELECT grp, i, {', '.join(f'min(CASE WHEN upto * 4 >= {k} * whole THEN x END) AS at{k}' for k in (1, 2, 3))} FROM la GROUP BY ALL))",
        f"mid AS MATERIALIZED (SELECT grp, {', '.join(f'max(CASE WHEN i = {i} THEN at2 END)::DOUBLE AS m{i}, max(CASE WHEN i = {i} THEN sd END) AS sd{i}' for i in range(P))} FROM quart GROUP BY grp)",
        f"zz AS (SELECT *, greatest(sqrt({total([f'z{i} * z{i}' for i in range(P)])}), 1e-9::DOUBLE) AS rr FROM (SELECT grp, {', '.join(f'({X[i]} - m{i}) / sd{i} AS z{i}' for i in range(P))} FROM g JOIN mid USING (grp)))",
        f"tu AS (SELECT grp, {', '.join(f'round(1024 * tanh(z{i}))::BIGINT AS t{i}, round(1024 * (z{i} / rr))::BIGINT AS u{i}' for i in range(P))} FROM zz)",
        f"ab AS (SELECT grp, count(*) AS n, {', '.join(f'sum(t{i})::BIGINT AS a{i}' for i in range(P))}, {', '.join(f'sum(t{i} * t{j})::BIGINT AS b{i}{j}, sum(u{i} * u{j})::BIGINT AS e{i}{j}' for i, j in PAIRS)} FROM tu GROUP BY grp)",
        f"av AS (SELECT *, {', '.join(f'{cov(i, i)} + 1 AS v{i}' for i in range(P))} FROM ab JOIN mid USING (grp))",
        "e0 AS MATERIALIZED ("
        + " UNION ALL ".join(f"SELECT grp, {k} AS start, {LINE} FROM {factored('(SELECT grp, ' + ', '.join(f'm{i}' for i in range(P)) + ', ' + ', '.join(f'sd{i} * sd{j} * {f(i, j)} AS c{i}{j}' for i, j in PAIRS) + ' FROM av)')}" for k, f in first.items())
        + ")",
    ]
    for k in range(MOST_STEPS):
        old = f"(SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY size, start) = 1)" if k == TRIAL_STEPS else f"e{k}"
        cte.append(f"d{k} AS MATERIALIZED (SELECT grp, start, {XS}, d2 FROM {distance(f'(SELECT * FROM g JOIN {old} USING (grp))')})")
        cte.append(f"e{k + 1} AS MATERIALIZED (SELECT grp, start, {LINE} FROM {estimated(f'(SELECT grp, start, {SUMS} FROM d{k} JOIN {reached(f"d{k}", "grp, start", *SUBSET, "cut")} USING (grp, start) WHERE {BUCKET} <= cut GROUP BY grp, start)')})")

    def scaled(name: str, source: str) -> list[str]:
        return [
            f"{name}_d AS MATERIALIZED (SELECT grp, {XS}, d2 FROM {distance(f'(SELECT * FROM g JOIN {source} USING (grp))')})",
            f"{name} AS MATERIALIZED (SELECT {source}.*, greatest(pow(2::DOUBLE, (half + 1)::DOUBLE / {BUCKETS}) / {NUMBER(chi_square(0.5))}, 1::DOUBLE) AS factor FROM {source} JOIN {reached(f'{name}_d', 'grp', 1, 2, 'half')} USING (grp))",
        ]

    cte += scaled("raw", f"e{MOST_STEPS}")
    cte.append(f"rw AS MATERIALIZED (SELECT grp, {LINE} FROM {estimated(f'(SELECT grp, {SUMS} FROM raw_d JOIN raw USING (grp) WHERE d2 / factor <= {NUMBER(chi_square(0.975))} GROUP BY grp)')})")
    cte += scaled("fin", "rw")
    judged = distance(f"(SELECT m.*, {vector}, fin.* EXCLUDE (grp) FROM m LEFT JOIN gs ON m.l IS NOT DISTINCT FROM gs.l AND m.s IS NOT DISTINCT FROM gs.s LEFT JOIN fin ON fin.grp = gs.grp)")
    return f"WITH {', '.join(cte)} SELECT doc_id, {', '.join(MEASURES)}, base_failed, NOT base_failed AND d2 / factor <= {NUMBER(chi_square(1 - TAIL))} AS kept FROM {judged}"


OP11 = quality()
