"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by source, language and topic in one map-side-combined aggregation. Values
that the targets don't name fall into ``other``, so the table of cells is bounded by the targets, which
are parameters, and is raked on the driver. Raking knows that no probability may be above 1: the sample's
size follows from the target that is scarcest in the table (``SLACK`` of what it allows, at least ``LEAST``
and at most ``KEEP`` of all tokens), and every marginal's wants are met at that size. A value that holds too
little even for ``LEAST`` is kept whole and the rest of its marginal scaled up; where marginals contradict each
other at that size, the last sweep's compromise stays. ``shares`` reports wanted, held and expected shares. Each document is then kept with its cell's calibrated probability, decided by a hash
of its id: the same document is decided alike at every size and on every retry.

Cases with a defined result: null sources, languages and texts count as ``other`` and zero words; a
null doc_id is decided as the id "null"; repeated rows are decided alike; a value that holds no
tokens is left out and the rest of its marginal scaled up; an empty table gives an empty result;
further columns pass through untouched, whatever their names, but columns of the marks' names are refused
where marks are kept.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, refuse_names, write_table

OTHER, SWEEPS, BUCKETS = "other", 40, 1 << 40
#: Most and least share of all tokens to keep, and how much of what the scarcest target allows is used.
KEEP, LEAST, SLACK = 0.8, 0.05, 0.9

#: Production targets: shares of tokens by marginal; what is left of 1 goes to ``other``.
SOURCES = {"src0": 0.30} | {f"src{i}": 0.035 for i in range(1, 20)}
LANGS = {"en": 0.62, "de": 0.14, "fr": 0.13, "es": 0.10}
TOPICS = {"prose": 0.90, "table": 0.04, "licensed": 0.04}
TARGETS = {"source": SOURCES, "lang": LANGS, "topic": TOPICS}


def words(text: Column) -> Column:
    """The number of words, runs of characters other than ASCII white space."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^ \t-\r]"), F.size(F.split(F.regexp_replace(text, r"^[ \t-\r]+|[ \t-\r]+$", ""), r"[ \t-\r]+"))).otherwise(0).cast("long")


def topic(text: Column) -> Column:
    """What kind of text it is: a licensed work, a table of cells, or prose."""
    return F.when(text.rlike(r"(?i)licensed? under|released under the"), "licensed").when(text.contains(" | "), "table").when(text.isNotNull(), "prose")


def _named(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(list(targets)), value).otherwise(OTHER)


def wants(held: np.ndarray, targets: np.ndarray, total: float) -> np.ndarray:
    """Tokens wanted of each value: in proportion to the targets, none above what is held, ``total`` in all."""
    want, most = np.where(held > 0, targets, 0.0), held.astype(float)
    order = np.argsort(most / np.where(want > 0, want, np.nan), kind="stable")  # the scarcest first, what isn't wanted last
    left, rest = total, want.sum()
    out = np.zeros(len(held))
    for i in order:
        if want[i] > 0:
            out[i] = min(most[i], left * want[i] / rest)
            left, rest = left - out[i], rest - want[i]
    return out


def size(cells: np.ndarray, targets: list[np.ndarray], keep: float = KEEP, least: float = LEAST) -> float:
    """The tokens to sample: what the scarcest target allows, within bounds."""
    allowed = []
    for axis, t in enumerate(targets):
        held = cells.sum(axis=tuple(i for i in range(cells.ndim) if i != axis))
        t = np.where(held > 0, t, 0)
        allowed += (held[t > 0] / (t[t > 0] / t.sum())).tolist()
    return float(min(keep * cells.sum(), max(least * cells.sum(), SLACK * min(allowed, default=np.inf))))


def rake(cells: np.ndarray, wanted: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Factors whose cut at 1, times ``cells`` (an array of one axis for each marginal), meets the wants."""
    factors = np.full(cells.shape, wanted[0].sum() / cells.sum())
    for _ in range(sweeps):
        for axis, want in enumerate(wanted):
            others = tuple(i for i in range(cells.ndim) if i != axis)
            now = (cells * np.minimum(factors, 1)).sum(axis=others)
            shape = [1] * cells.ndim
            shape[axis] = -1
            factors = factors * np.divide(want, now, out=np.zeros_like(now), where=now > 0).reshape(shape)
    return factors


def _table(tokens: dict[tuple[str, ...], int], targets: dict[str, dict[str, float]]) -> tuple[list[list[str]], np.ndarray, list[np.ndarray]]:
    axes = [[*t, OTHER] for t in targets.values()]
    cells = np.zeros([len(a) for a in axes])
    for key, n in tokens.items():
        cells[tuple(a.index(k) for a, k in zip(axes, key))] = n
    return axes, cells, [np.array([*t.values(), max(0.0, 1 - sum(t.values()))]) for t in targets.values()]


def calibrated(tokens: dict[tuple[str, ...], int], targets: dict[str, dict[str, float]], keep: float = KEEP, least: float = LEAST) -> dict[tuple[str, ...], float]:
    """Each cell's probability: its raked factor, at most 1."""
    axes, cells, marginals = _table(tokens, targets)
    if not cells.any():
        return {}
    total = size(cells, marginals, keep, least)
    held = [cells.sum(axis=tuple(j for j in range(cells.ndim) if j != i)) for i in range(cells.ndim)]
    factors = rake(cells, [wants(h, t, total) for h, t in zip(held, marginals)])
    return {key: round(min(1.0, float(factors[i])), 9) for key, i in zip(itertools.product(*axes), itertools.product(*(range(len(a)) for a in axes))) if cells[i] > 0}


def expected_shares(tokens: dict[tuple[str, ...], int], chance: dict[tuple[str, ...], float], targets: dict[str, dict[str, float]]) -> list[tuple[str, str, float, float, float]]:
    """``(marginal, value, target, held, expected)`` shares of tokens."""
    axes, cells, marginals = _table(tokens, targets)
    kept = np.zeros_like(cells)
    for key, p in chance.items():
        at = tuple(a.index(k) for a, k in zip(axes, key))
        kept[at] = cells[at] * p
    out = []
    for i, (name, axis, want) in enumerate(zip(targets, axes, marginals)):
        others = tuple(j for j in range(cells.ndim) if j != i)
        for v, t, h, e in zip(axis, want, cells.sum(axis=others), kept.sum(axis=others)):
            out.append((name, v, float(t), float(h / max(1, cells.sum())), float(e / max(1e-9, kept.sum()))))
    return out


def mark(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their token count and cell, and under which names these are."""
    targets = targets or TARGETS
    names = {n: free_name(docs, f"__{n}") for n in ("tokens", "source", "lang", "topic")}
    marks = {"tokens": words(F.col("text")), "source": _named(F.col("source"), targets["source"]), "lang": _named(F.col("lang"), targets["lang"]), "topic": _named(topic(F.col("text")), targets["topic"])}
    return docs.withColumns({names[n]: c for n, c in marks.items()}), names


def cell_tokens(marked: DataFrame, names: dict[str, str]) -> dict[tuple[str, ...], int]:
    """Tokens by cell; no more rows than the targets have cells."""
    sums = marked.groupBy(*(names[n] for n in ("source", "lang", "topic"))).agg(F.sum(names["tokens"]).alias("n"))
    return {tuple(r[:3]): r.n for r in sums.collect()}


def decide(marked: DataFrame, names: dict[str, str], targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, least: float = LEAST) -> tuple[Column, Column]:
    """A marked row's probability, and whether it is sampled."""
    keys = [F.col(names[n]) for n in ("source", "lang", "topic")]
    chance = calibrated(cell_tokens(marked, names), targets or TARGETS, keep, least)
    cut = F.create_map(*(F.lit(x) for key, p in chance.items() for x in ("\x1f".join(key), p))) if chance else F.lit(None).cast("map<string,double>")
    p = F.coalesce(cut[F.concat_ws("\x1f", *keys)], F.lit(1.0))
    spot = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 10), 16, 10).cast("long")
    return p, spot < F.round(p * BUCKETS).cast("long")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, least: float = LEAST) -> DataFrame:
    """The sampled rows with all their columns."""
    marked, names = mark(docs, targets)
    _, sampled = decide(marked, names, targets, keep, least)
    return marked.where(sampled).drop(*names.values())


def mix_marks(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, least: float = LEAST) -> DataFrame:
    """Every row but its text, with ``tokens, cell_source, cell_lang, cell_topic, probability, sampled``. Texts
    are read once: the marks are written down before they are summed."""
    refuse_names(docs, "tokens", "cell_source", "cell_lang", "cell_topic", "probability", "sampled")
    marked, names = mark(docs, targets)
    marked, _ = write_table(marked.drop("text"), "marks")
    p, sampled = decide(marked, names, targets, keep, least)
    others = [c for c in docs.columns if c != "text"]
    return marked.select(*others, F.col(names["tokens"]).alias("tokens"), *(F.col(names[n]).alias(f"cell_{n}") for n in ("source", "lang", "topic")), p.alias("probability"), sampled.alias("sampled"))


def shares(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, least: float = LEAST) -> DataFrame:
    """``marginal, value, target, held, expected``: how near the sample comes to its targets."""
    targets = targets or TARGETS
    marked, names = mark(docs, targets)
    tokens = cell_tokens(marked, names)
    rows = expected_shares(tokens, calibrated(tokens, targets, keep, least), targets)
    return docs.sparkSession.createDataFrame(rows, "marginal string, value string, target double, held double, expected double")


def _sql_words(text: str) -> str:
    return f"len(regexp_extract_all(coalesce({text}, ''), '[^ \\t-\\r]+'))"


def sql(table: str = "documents", targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> str:
    """The same in DuckDB SQL: the sweeps are unrolled over the table of cells."""
    targets = targets or TARGETS
    quoted = lambda t: ", ".join(f"'{k}'" for k in t)
    parts = [
        f"""marked AS (SELECT doc_id, {_sql_words('text')} AS tokens,
      CASE WHEN source IN ({quoted(targets['source'])}) THEN source ELSE 'other' END AS k0,
      CASE WHEN lang IN ({quoted(targets['lang'])}) THEN lang ELSE 'other' END AS k1,
      CASE WHEN regexp_matches(text, '(?i)licensed? under|released under the') THEN 'licensed' WHEN contains(text, ' | ') THEN 'table' WHEN text IS NOT NULL THEN 'prose' ELSE 'other' END AS k2 FROM {table})"""
    ]
    for i, t in enumerate(targets.values()):
        rest = max(0.0, 1 - sum(t.values()))
        parts.append(f"want{i} AS (SELECT * FROM (VALUES {', '.join(f'(\'{k}\', {v!r}::DOUBLE)' for k, v in [*t.items(), (OTHER, rest)])}) v(k, w))")
    parts.append("cell AS MATERIALIZED (SELECT k0, k1, k2, sum(tokens)::DOUBLE AS n FROM marked GROUP BY ALL HAVING sum(tokens) > 0)")
    # What each value holds and its target; the size that the scarcest allows; wants, the scarcest value's first.
    parts.append("held AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS axis, k, h, w / sum(w) OVER () AS t FROM (SELECT k{i} AS k, sum(n) AS h FROM cell GROUP BY 1) JOIN want{i} USING (k) WHERE w > 0" for i in range(3)) + ")")
    parts.append(f"size AS MATERIALIZED (SELECT least({KEEP!r} * s, greatest({LEAST!r} * s, {SLACK!r} * (SELECT min(h / t) FROM held))) AS total FROM (SELECT sum(n) AS s FROM cell))")
    parts.append(
        """filled AS MATERIALIZED (SELECT axis, k, h, t, total,
      coalesce(sum(h) OVER (PARTITION BY axis ORDER BY h / t, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(t) OVER (PARTITION BY axis ORDER BY h / t, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM held, size)"""
    )
    # The multiple of the targets at which the wants sum up is that of the first value not kept whole.
    parts.append("multiple AS (SELECT axis, arg_min((total - before) / rest, h / t) AS m FROM filled WHERE (total - before) / rest <= h / t GROUP BY 1)")
    parts.append("wanted AS MATERIALIZED (SELECT axis, k, least(h, m * t) AS w FROM held JOIN multiple USING (axis))")
    parts.append("s AS MATERIALIZED (SELECT k0, k1, k2, n, total / sum(n) OVER () AS f FROM cell, size)")
    last = "s"
    for sweep in range(sweeps):
        for i in range(3):
            name = f"s{sweep}_{i}"
            parts.append(f"{name} AS MATERIALIZED (SELECT k0, k1, k2, n, f * coalesce(w / now, 0) AS f FROM (SELECT *, sum(n * least(f, 1)) OVER (PARTITION BY k{i}) AS now FROM {last}) c LEFT JOIN wanted ON axis = {i} AND k = k{i})")
            last = name
    parts.append(f"chance AS (SELECT k0, k1, k2, round(least(1.0, f), 9) AS p FROM {last})")
    parts.append(
        """decided AS (SELECT m.*, coalesce(c.p, 1.0) AS p, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 10))::BIGINT < round(coalesce(c.p, 1.0) * 1099511627776)::BIGINT AS sampled FROM marked m LEFT JOIN chance c USING (k0, k1, k2))"""
    )
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, tokens::BIGINT AS tokens, k0 AS cell_source, k1 AS cell_lang, k2 AS cell_topic, p AS probability, sampled FROM decided"
