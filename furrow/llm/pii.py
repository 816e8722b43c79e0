"""Personal data: candidate spans, boosted trees over them, redaction.

Generators with high recall propose spans, which may overlap. Four of them are
the base kinds (email, ip, card, phone): their matches that pass the kind's
check are always reported. The others propose written-out addresses, phone
numbers without a country code, bare digit runs and long mixed tokens. Each
candidate gets small whole-number features of its format and of the characters
and words beside it. Gradient-boosted trees score the features; a span that is
not in the base set is added where its score reaches the threshold of its kind,
which is the lowest score at which the weak labels reach ``PRECISION``.

Weak labels come from the checks themselves: a candidate counts as personal data
if a base span of its kind overlaps it, or if it is a token that a key word and
an assignment sign precede. Training needs only the count of candidates and of
labels per combination of feature values. That table is bounded by the number of
combinations (``FEATURES``), whatever the input, so all candidates of all
documents are used and nothing else reaches the driver.

Everything on the rows is SQL expressions inside one narrow stage: no shuffle,
and no position is found by scanning a text twice for the same match. Positions
are code points, the end is exclusive. Added spans never overlap base spans or
each other: of two, the one that starts first stays, then the longer.

Null and empty texts have no spans. Rows are kept one for one, ties and repeated
rows included. An empty table gives no rows, and a table without candidates adds
no spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from furrow.session import checkpointed

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
PRECISION = 0.95
LEAST_LABELS = 20  # weak labels a kind needs before it may add spans
ROUNDS, RATE = 40, 0.3
BLOCK = 256  # matches summed at a time
LEFT, RIGHT = 24, 8  # code points of context on either side

# Matches of the base kinds: no retry inside a match that fails its check. The
# possessive forms match the same text as the plain ones, without backtracking.
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Generator:
    kind: str
    regex: str
    needs: str  # a cheap test on the text
    check: str  # passes for the candidate ``m`` with digits ``d``
    base: bool


GENERATORS = (
    Generator("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", True),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "n", f"m rlike '^(?:{_PART}\\.){{3}}{_PART}$'", True),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", "n", "char_length(d) between 16 and 19 and luhn_check(d)", True),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "n and contains(t, '+')", "char_length(d) between 8 and 15", True),
    Generator(
        "email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?[(\[](?:dot|DOT)[)\]] ?[A-Za-z0-9-]++)++",
        "t rlike '(?:at|AT)[)\\\\]]'",
        "true",
        False,
    ),
    Generator("phone", r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "n", "true", False),
    Generator("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", "n", "true", False),
    Generator("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+", "n", "m rlike '[0-9]' and m rlike '[A-Za-z]'", False),
)

# Features: name, SQL over the candidate ``m``, its digits ``d``, the text before
# it ``l`` and after it ``r``, and the number of values.
FEATURES = (
    ("gen", "{gen}", len(GENERATORS)),
    ("size", "least(7, char_length(m) div 6)", 8),
    ("digits", "(4 * char_length(d)) div char_length(m)", 5),
    ("marks", "least(3, char_length(m) - char_length(regexp_replace(m, '[^A-Za-z0-9]', '')))", 4),
    ("word", "case when lower(l) rlike '(?:token|secret|key|password|passwd|auth)[^a-z]*$' then 1 when lower(l) rlike '(?:tel|phone|call|fax)[^a-z]*$' then 2"
     " when lower(l) rlike '(?:mail|contact)[^a-z]*$' then 3 when lower(l) rlike '(?:card|visa|account)[^a-z]*$' then 4 else 0 end", 5),
    ("sign", "case when l rlike '[=:][ ]?[\"'']?$' then 1 else 0 end", 2),
    ("before", "case when l = '' then 0 when l rlike '[A-Za-z0-9]$' then 1 when l rlike '[ \\n\\t]$' then 2 else 3 end", 4),
    ("after", "case when r = '' then 0 when r rlike '^[A-Za-z0-9]' then 1 when r rlike '^[ \\n\\t]' then 2 else 3 end", 4),
)
NAMES = [name for name, _, _ in FEATURES]


# --- candidates ------------------------------------------------------------------------


def _escaped(regex: str) -> str:
    return regex.replace("\\", "\\\\").replace("'", "\\'")


def running_sums(steps: str) -> str:
    """SQL for the sums of the elements before each element, in blocks: the cost
    is linear but for one small copy per element."""
    blocks = f"sequence(0, (size({steps}) - 1) div {BLOCK})"
    part = f"slice({steps}, b * {BLOCK} + 1, {BLOCK})"
    bases = (
        f"aggregate({blocks}, array(0L), (acc, b) -> array_append(acc, element_at(acc, -1) + aggregate({part}, 0L, (x, y) -> x + y)))"
    )
    inner = f"slice(aggregate({part}, array(get(bases, b)), (acc, y) -> array_append(acc, element_at(acc, -1) + y)), 1, size({part}))"
    return f"if(size({steps}) = 0, array(), flatten(transform({blocks}, b -> get(transform(array({bases}), bases -> {inner}), 0))))"


def with_candidates(docs: DataFrame, text_col: str = "text", out: str = "_cands") -> DataFrame:
    """Add the candidates of every text, in generator and text order. Columns
    starting with ``_pii_`` are used on the way and must not exist."""
    rows = docs.withColumn("_pii_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn("_pii_n", F.expr("_pii_t rlike '[0-9]'"))
    names = lambda g: (f"_pii_f{g}", f"_pii_p{g}", f"_pii_s{g}")
    for g, gen in enumerate(GENERATORS):
        needs = gen.needs.replace("contains(t,", "contains(_pii_t,").replace("t rlike", "_pii_t rlike")
        needs = " and ".join("_pii_n" if x == "n" else x for x in needs.split(" and "))
        rows = rows.withColumn(names(g)[0], F.expr(f"if({needs}, regexp_extract_all(_pii_t, '{_escaped(gen.regex)}', 0), cast(array() as array<string>))"))
    for g, gen in enumerate(GENERATORS):
        found, pieces, _ = names(g)
        rows = rows.withColumn(pieces, F.expr(f"if(size({found}) > 0, split(_pii_t, '{_escaped(gen.regex)}', -1), cast(array() as array<string>))"))
    for g in range(len(GENERATORS)):
        found, pieces, starts = names(g)
        steps = f"_pii_w{g}"
        rows = rows.withColumn(steps, F.expr(f"transform({found}, (m, i) -> cast(char_length(get({pieces}, i)) + char_length(m) as bigint))"))
        rows = rows.withColumn(starts, F.expr(f"cast({running_sums(steps)} as array<bigint>)"))
    groups = []
    for g, gen in enumerate(GENERATORS):
        found, pieces, starts = names(g)
        feats = ", ".join(f"'{n}', cast({sql.format(gen=g)} as int)" for n, sql, _ in FEATURES)
        # One-element arrays name what several features share.
        one = (
            f"get(transform(array(struct(regexp_replace(m, '[^0-9]', '') as d, right(get({pieces}, i), {LEFT}) as l, left(get({pieces}, i + 1), {RIGHT}) as r,"
            f" get({starts}, i) + char_length(get({pieces}, i)) as s)), q -> named_struct('kind', {KINDS.index(gen.kind)}, 'start', q.s,"
            f" 'end', q.s + char_length(m), 'check', ({_named(gen.check)}), 'base', {str(gen.base).lower()} and ({_named(gen.check)}), {_named(feats)})), 0)"
        )
        groups.append(f"transform({found}, (m, i) -> {one})")
    kept = "filter(concat({}), x -> x.gen < 4 or x.check)".format(", ".join(groups))
    return rows.withColumn(out, F.expr(kept)).select(*docs.columns, out)


def _named(sql: str) -> str:
    """Point the short names of checks and features at the shared struct."""
    import re

    return re.sub(r"(?<![\w'.])([dlr])(?= rlike|\)| =|,)", r"q.\1", sql)


def labelled(cands: str = "_cands") -> str:
    """SQL for the candidates with their weak label."""
    base = f"filter({cands}, y -> y.base)"
    return (
        f"transform({cands}, x -> struct(x.*, (x.base or (x.kind = {KINDS.index('secret')} and x.word = 1 and x.sign = 1)"
        f" or exists({base}, y -> y.kind = x.kind and y.start < x.end and x.start < y.end)) as label))"
    ).replace("struct(x.*, ", "struct(" + ", ".join(f"x.{n} as {n}" for n in ["kind", *NAMES]) + ", ")


# --- boosted trees ---------------------------------------------------------------------


@dataclass
class Model:
    """Sum of depth-two trees plus a start value, with a threshold per kind."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def sql(self, x: str) -> str:
        """The score of a candidate struct ``x`` as SQL."""

        def branch(node) -> str:
            if isinstance(node, float):
                return f"{node!r}D"
            at, cut, low, high = node
            return f"if({x}.{NAMES[at]} <= {cut}, {branch(low)}, {branch(high)})"

        return " + ".join([f"{self.start!r}D", *(branch(t) for t in self.trees)])

    def threshold_sql(self, x: str) -> str:
        cases = " ".join(f"when {k} then {v!r}D" for k, v in self.thresholds.items())
        return f"case {x}.kind {cases} else double('infinity') end" if cases else "double('infinity')"

    def score(self, values: np.ndarray) -> np.ndarray:
        def branch(node):
            if isinstance(node, float):
                return np.full(len(values), node)
            at, cut, low, high = node
            return np.where(values[:, at] <= cut, branch(low), branch(high))

        return self.start + sum((branch(t) for t in self.trees), np.zeros(len(values)))


def _split(values, grad, hess, rows):
    """(gain, feature, cut) of the best cut of some rows."""
    best = (1e-9, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    for at in range(values.shape[1]):
        top = FEATURES[at][2]
        gs = np.bincount(values[rows, at], grad[rows], top).cumsum()[:-1]
        hs = np.bincount(values[rows, at], hess[rows], top).cumsum()[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), at, int(gain.argmax()))
    return best


def boost(values: np.ndarray, count: np.ndarray, positive: np.ndarray, kind: np.ndarray) -> Model:
    """Fit on combinations of feature values: how often each occurs, and how
    often with a positive label."""
    model = Model()
    if not len(values) or positive.sum() == 0:
        return model
    share = min(max(positive.sum() / count.sum(), 1e-4), 1 - 1e-4)
    model.start = math.log(share / (1 - share))
    score = np.full(len(values), model.start)

    def leaf(rows) -> float:
        return float(RATE * grad[rows].sum() / (hess[rows].sum() + 1))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        grad, hess = positive - count * p, count * p * (1 - p)
        every = np.arange(len(values))
        gain, at, cut = _split(values, grad, hess, every)
        if at is None:
            break
        sides = []
        for rows in (every[values[:, at] <= cut], every[values[:, at] > cut]):
            gain, below, edge = _split(values, grad, hess, rows)
            if below is None:
                sides.append(leaf(rows))
            else:
                low = values[rows, below] <= edge
                sides.append((below, edge, leaf(rows[low]), leaf(rows[~low])))
        model.trees.append((at, cut, *sides))
        score = model.score(values)
    for k in range(len(KINDS)):
        mine = kind == k
        if positive[mine].sum() < LEAST_LABELS:
            continue
        order = np.argsort(-score[mine], kind="stable")
        s, n, hit = score[mine][order], count[mine][order].cumsum(), positive[mine][order].cumsum()
        last = np.append(s[1:] != s[:-1], True)  # whole groups of equal scores
        good = np.flatnonzero(last & (hit >= PRECISION * n))
        if len(good):
            model.thresholds[k] = float(s[good[-1]]) - 1e-9
    return model


def fit(candidates: DataFrame, cands: str = "_cands") -> Model:
    """Train on all candidates of a table that has them."""
    keys = ["kind", *NAMES]
    table = (
        candidates.select(F.explode(F.expr(labelled(cands))).alias("x"))
        .select(*(F.col(f"x.{k}").alias(k) for k in keys), F.col("x.label").cast("bigint").alias("hit"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
        .orderBy(*keys)
        .collect()  # one row per combination of feature values
    )
    if not table:
        return Model()
    values = np.array([[r[n] for n in NAMES] for r in table], np.int64)
    return boost(values, *(np.array([r[c] for r in table], float) for c in ("n", "hits")), np.array([r["kind"] for r in table]))


# --- spans -----------------------------------------------------------------------------


def with_spans(candidates: DataFrame, model: Model, cands: str = "_cands") -> DataFrame:
    """Add ``_base`` and ``_all``: arrays of (kind, start, end), by kind then start."""
    span = "struct(x.kind as kind, x.start as start, x.end as end)"
    rows = candidates.withColumn("_base", F.expr(f"transform(filter({cands}, x -> x.base), x -> {span})"))
    wanted = f"transform(filter({cands}, x -> not x.base and ({model.sql('x')}) >= {model.threshold_sql('x')}), x -> {span})"
    rows = rows.withColumn("_more", F.expr(wanted if model.thresholds else "slice(_base, 1, 0)"))
    # Forward: nothing that starts before a base span or an added one has ended.
    # A base span sorts before an added one that starts with it.
    marked = "concat(transform(_base, x -> struct(x.start as s, 0 as added, -x.end as e, x.kind as k)), transform(_more, x -> struct(x.start as s, 1 as added, -x.end as e, x.kind as k)))"
    empty = "cast(array() as array<struct<s:bigint,added:int,e:bigint,k:int>>)"
    backward = (
        f"aggregate(reverse(_sorted), struct(9223372036854775807L as edge, {empty} as kept), (acc, x) -> if(x.added = 0, struct(least(acc.edge, x.s) as edge, array_append(acc.kept, x) as kept),"
        " if(-x.e > acc.edge, acc, struct(acc.edge as edge, array_append(acc.kept, x) as kept))), acc -> reverse(acc.kept))"
    )
    forward = (
        f"aggregate(_clear, struct(-1L as edge, {empty} as kept), (acc, x) -> if(x.added = 0, struct(greatest(acc.edge, -x.e) as edge, acc.kept as kept),"
        " if(x.s < acc.edge, acc, struct(-x.e as edge, array_append(acc.kept, x) as kept))), acc -> acc.kept)"
    )
    both = "if(size(_more) = 0, _base, array_sort(concat(_base, transform({}, x -> struct(x.k as kind, x.s as start, -x.e as end)))))"
    return (
        rows.withColumn("_sorted", F.expr(f"if(size(_more) = 0, {empty}, array_sort({marked}))"))
        .withColumn("_clear", F.expr(f"if(size(_more) = 0, {empty}, {backward})"))
        .withColumn("_all", F.expr(both.format(forward)))
        .drop("_more", "_sorted", "_clear")
    )


def spans_text(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({kinds}, x.kind), ':', x.start, ':', x.end)), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    found = checkpointed(with_candidates(slim, "_text").drop("_text"), docs.sparkSession, "pii-candidates")
    rows = with_spans(found, fit(found))
    counts = [F.expr(f"cast(size(filter(_base, x -> x.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return rows.select("doc_id", *counts, F.sha2(spans_text("_base"), 256).alias("base_sha256"), spans_text("_all").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets. Columns may have any names."""
    # Positions stand for the columns meanwhile, so that none meets a name used on the way.
    body = f"c{docs.columns.index(text_col)}"
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    rows = checkpointed(with_candidates(rows, body), docs.sparkSession, "pii-rows")
    rows = with_spans(rows, fit(rows))
    kinds = "array(" + ", ".join(f"'{k.upper()}'" for k in KINDS) + ")"
    # Base spans of two kinds may overlap; what is already covered is not repeated.
    by_start = "array_sort(transform(_all, x -> struct(x.start as s, x.end as e, x.kind as k)))"
    walked = (
        f"aggregate({by_start}, struct(0L as edge, cast(array() as array<string>) as parts), (acc, x) -> struct(greatest(acc.edge, x.e) as edge,"
        f" if(x.s < acc.edge, acc.parts, concat(acc.parts, array(substring({body}, cast(acc.edge + 1 as int), cast(x.s - acc.edge as int)), concat('[', get({kinds}, x.k), ']')))) as parts),"
        f" acc -> concat(array_join(acc.parts, ''), substring({body}, cast(acc.edge + 1 as int))))"
    )
    masked = F.expr(f"if(size(_all) = 0, {body}, {walked})")
    return rows.select(*(masked.alias(c) if c == body else F.col(c) for c in rows.columns if c.startswith("c"))).toDF(*docs.columns)
