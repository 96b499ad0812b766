"""Exponentially weighted means over long series, exact across gaps.

Spark has no recurrence operator, so the recurrence is written as prefix sums.

* Rows are cut into runs of ``RUN`` rows. Inside a run a decayed sum is
  ``exp(-S_t) * sum(b_j * exp(S_j))`` with S the decay (in nats) since the start of the run;
  RUN keeps exp(S) far below overflow for spans above 1.5.
* Each run ends in one summary row. Across runs the state obeys ``C = C_prev*exp(-nats) + add``.
  Two such steps make one of the same form, so blocks of ``FAN`` summaries are folded into one, level
  by level, until a series has one block; on the way back the state at the start of a block enters
  its window as a row before the first.
* The state at the start of its run is joined back to every row.

No task has to see more than a run of bars or a block of summaries. How many levels there are follows
from the number of bars.

``adjust=True``: weighted sum over sum of weights, weights d**age, d = 1 - 2/(span+1).
``adjust=False``: y = d*y + (1-d)*x from y = first x. After k-1 missing rows the old weight
has decayed to d**k, and the next value is (d**k*y + (1-d)*x) / (d**k + 1-d).
In both, a missing row keeps the last value and rows before the first value are missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_of
from ..session import materialize
from .blocks import Ordered

RUN = 256
FAN = 256            # run or block summaries folded into one
BUCKET_NATS = 200.0
TINY = 1e-280
POSITION = f"CAST(seq % {RUN} AS DOUBLE)"


@dataclass(frozen=True)
class Ewm:
    """Mean ``out`` of column ``source`` with the given span."""

    out: str
    source: str
    span: float
    adjust: bool

    def __post_init__(self) -> None:
        if self.span < 1.5:
            raise ValueError("span must be at least 1.5")

    @property
    def decay(self) -> float:
        return 1.0 - 2.0 / (self.span + 1.0)

    @property
    def nats(self) -> float:
        return -math.log(self.decay)

    def new_share(self, steps: str) -> str:
        """Weight of a new value that arrives ``steps`` rows after the one before (SQL)."""
        fresh = f"{1 - self.decay!r}D"
        return f"if({steps} = 1, {fresh}, {fresh} / {self._total(steps)})"

    def step_nats(self, steps: str) -> str:
        """Decay of the old state caused by that value (SQL)."""
        gap = f"{steps} * {self.nats!r}D + ln({self._total(steps)})"
        return f"if({steps} = 1, {self.nats!r}D, {gap})"

    def _total(self, steps: str) -> str:
        return f"(exp(-{self.nats!r}D * {steps}) + {1 - self.decay!r}D)"


def ewm_means(o: Ordered, means: list[Ewm]) -> Ordered:
    """Add one column per entry of ``means``.

    Expressions are SQL text: there are many of them, and a text costs the driver one call.
    """
    keys = ", ".join(f"`{k}`" for k in o.keys)
    sources = list(dict.fromkeys(m.source for m in means))
    inside = _inside_runs(o.df, o.keys, means, sources)
    states = _run_states(inside, keys, means, sources, _levels(o.rows))
    # Runs were laid out by this key for the window, so the join moves the states only.
    states = states.withColumn("_key", key_of(*o.keys, "_run")).drop(*o.keys, "_run")
    joined = inside.join(states, "_key")
    out = [f"{_value(i, m, sources.index(m.source))} AS `{m.out}`" for i, m in enumerate(means)]
    return o.with_df(joined.selectExpr(*[f"`{c}`" for c in o.df.columns], *out))


def _levels(rows: int) -> int:
    """Levels above the run summaries, until all runs of the longest possible series are one block."""
    levels, blocks = 0, -(-rows // RUN)
    while blocks > FAN:
        levels, blocks = levels + 1, -(-blocks // FAN)
    return levels


def _inside_runs(df: DataFrame, keys: tuple[str, ...], means: list[Ewm], sources: list[str]) -> DataFrame:
    """Sums since the start of the run, in three levels over one window."""
    line = "PARTITION BY _key ORDER BY seq"
    upto = f"OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    seen = [f"lead(seq) OVER ({line}) IS NULL AS _end"]
    for j, x in enumerate(sources):
        here = f"CASE WHEN `{x}` IS NOT NULL THEN seq END"
        seen += [
            f"max({here}) {before} AS _prev{j}",
            f"min({here}) {upto} AS _first{j}",
            f"max({here}) {upto} AS _last{j}",
            f"first(`{x}`, true) {upto} AS _head{j}",
        ]

    decays, sums = [], []
    for i, m in enumerate(means):
        j, x = sources.index(m.source), f"`{m.source}`"
        if m.adjust:
            weight = f"CASE WHEN {x} IS NOT NULL THEN exp({POSITION} * {m.nats!r}D) END"
            fade = f"exp({POSITION} * -{m.nats!r}D)"
            sums += [
                f"coalesce(sum({x} * {weight}) {upto} * {fade}, 0D) AS _num{i}",
                f"coalesce(sum({weight}) {upto} * {fade}, 0D) AS _den{i}",
            ]
        else:
            steps = f"(CASE WHEN {x} IS NOT NULL THEN seq END - _prev{j})"
            decays.append(f"coalesce(sum({m.step_nats(steps)}) {upto}, 0D) AS _nats{i}")
            sums.append(
                f"coalesce(sum({m.new_share(steps)} * {x} * exp(_nats{i})) {upto}, 0D)"
                f" * exp(-_nats{i}) AS _sum{i}"
            )
    runs = df.withColumn("_run", F.floor(F.col("seq") / RUN)).withColumn("_key", key_of(*keys, "_run"))
    for level in (seen, decays, sums):
        runs = runs.selectExpr("*", *level)
    return runs


def _run_states(
    inside: DataFrame, keys: str, means: list[Ewm], sources: list[str], levels: int
) -> DataFrame:
    """State of every mean at the start of each run, one row per run."""
    by = keys.split(", ")
    lasts, befores = ([f"_{x}{j}" for j in range(len(sources))] for x in ("last", "before"))
    sums = [p for i, m in enumerate(means) for p in ((f"_num{i}", f"_den{i}") if m.adjust else (f"_nats{i}", f"_sum{i}"))]
    firsts = [f"_{x}{j}" for j in range(len(sources)) for x in ("first", "head")]
    ends = inside.where("_end").select(*by, "_run", "seq", *lasts, *firsts, *sums)
    if levels:
        # Each level reads the summaries twice, so they are stored; they are RUN times fewer than bars.
        ends = materialize(ends, "runs")
    seen = _running_max(ends, by, dict(zip(lasts, befores, strict=True)), levels, "1 PRECEDING")
    parts = [part for i, m in enumerate(means) for part in _recurrences(i, m, sources)]
    structs = ", ".join(
        f"named_struct('part', '{name}', 'nats', {nats}, 'add', {add})"
        for name, nats, add in parts
    )
    tall = seen.selectExpr(*by, "_run", *befores, f"inline(array({structs}))")
    if levels:
        tall = materialize(tall, "steps")
    states = (
        _solve(tall, keys, levels)
        .groupBy(*[F.expr(k) for k in by], "_run")
        .agg(
            *[F.expr(f"first({b}) AS {b}") for b in befores],
            *[F.expr(f"max(state) FILTER (WHERE part = '{p}') AS _state_{p}") for p, _, _ in parts],
        )
    )
    # Weighted sums fade to nothing over very long gaps, but their ratio does not change there.
    ratio = (
        "CASE WHEN _state_den{i} > {t!r}D"
        " THEN named_struct('run', _run, 'ratio', _state_num{i} / _state_den{i}) END AS _ratio{i}"
    )
    adjusted = [i for i, m in enumerate(means) if m.adjust]
    if not adjusted:
        return states
    rated = states.selectExpr("*", *[ratio.format(i=i, t=TINY) for i in adjusted])
    if levels:
        rated = materialize(rated, "states")
    kept = _running_max(rated, by, {f"_ratio{i}": f"_kept{i}" for i in adjusted}, levels, "CURRENT ROW")
    return kept.withColumns({f"_kept{i}": F.col(f"_kept{i}.ratio") for i in adjusted}).drop(
        *[f"_ratio{i}" for i in adjusted]
    )


def _running_max(
    runs: DataFrame, by: list[str], names: dict[str, str], levels: int, last: str
) -> DataFrame:
    """Largest value of each column so far (``last`` ends the frame), by blocks as in ``_solve``."""
    blocked = runs.withColumn("_block", F.floor(F.col("_run") / FAN))
    if levels:
        tops = blocked.groupBy(*[F.expr(k) for k in by], F.col("_block").alias("_run")).agg(
            *[F.max(n).alias(n) for n in names]
        )
        before = {n: f"{n}_so_far" for n in names}
        tops = _running_max(tops, by, before, levels - 1, "1 PRECEDING")
        starts = tops.selectExpr(
            *by, "_run AS _block", "-1L AS _run", *[f"{b} AS {n}" for n, b in before.items()]
        )
        blocked = blocked.unionByName(starts, allowMissingColumns=True)
    line = f"OVER (PARTITION BY {', '.join(by)}, _block ORDER BY _run ROWS BETWEEN UNBOUNDED PRECEDING AND {last})"
    return (
        blocked.selectExpr("*", *[f"max({n}) {line} AS {out}" for n, out in names.items()])
        .where("_run >= 0")
        .drop("_block")
    )


def _recurrences(i: int, m: Ewm, sources: list[str]) -> list[tuple[str, str, str]]:
    """(name, nats, add) of the run-to-run recurrences behind one mean."""
    if m.adjust:
        nats = f"({POSITION} + 1) * {m.nats!r}D"
        return [(f"{kind}{i}", nats, f"_{kind}{i}") for kind in ("num", "den")]
    j = sources.index(m.source)
    gap = f"(_first{j} - _before{j})"
    # The first value of the run meets the state of earlier runs; the very first has share 1.
    share = f"coalesce({m.new_share(gap)}, 1D)"
    nats = f"_nats{i} + coalesce({m.step_nats(gap)}, 0D)"
    add = f"exp(-_nats{i}) * {share} * _head{j} + _sum{i}"
    empty = f"_first{j} IS NULL"
    return [(f"sum{i}", f"if({empty}, 0D, {nats})", f"if({empty}, 0D, {add})")]


def _solve(tall: DataFrame, keys: str, levels: int) -> DataFrame:
    """``state`` before each run for C = C_prev*exp(-nats) + add.

    Runs of a block are bucketed by total decay; inside a bucket the weights stay within exp(200), and
    what lies two buckets back has decayed below any double, so one carried value is exact.
    """
    blocked = tall.withColumn("_block", F.floor(F.col("_run") / FAN))
    if levels:
        step = "named_struct('nats', done.nats + x.nats, 'add', done.add * exp(-x.nats) + x.add)"
        # At most FAN summaries meet in one array.
        folded = blocked.groupBy(*[F.expr(k) for k in keys.split(", ")], "part", "_block").agg(
            F.expr(
                "aggregate(array_sort(collect_list(struct(_run, nats, add))),"
                f" named_struct('nats', 0D, 'add', 0D), (done, x) -> {step}) AS _fold"
            )
        )
        above = folded.selectExpr(*keys.split(", "), "part", "_block AS _run", "_fold.nats", "_fold.add")
        starts = _solve(above, keys, levels - 1).selectExpr(
            *keys.split(", "), "part", "_run AS _block", "-1L AS _run", "0D AS nats", "state AS add"
        )
        blocked = blocked.unionByName(starts, allowMissingColumns=True)
    line = f"PARTITION BY {keys}, part, _block ORDER BY _run"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    inner = f"(_total - _bucket * {BUCKET_NATS!r}D)"
    return (
        blocked.selectExpr("*", f"sum(nats) OVER ({line} {upto}) AS _total")
        .selectExpr("*", f"floor(_total / {BUCKET_NATS!r}D) AS _bucket")
        .selectExpr(
            "*",
            f"sum(add * exp({inner})) OVER (PARTITION BY {keys}, part, _block, _bucket ORDER BY _run"
            f" {upto}) * exp(-{inner}) AS _local",
            f"lead(_bucket) OVER ({line}) <> _bucket AS _closes",
        )
        .selectExpr(
            "*",
            f"last(if(_closes, named_struct('local', _local, 'total', _total), NULL), true)"
            f" OVER ({line} {before}) AS _carry",
        )
        .selectExpr(
            "*",
            "_local + coalesce(_carry.local * exp(_carry.total - _total), 0D) AS _state",
        )
        .selectExpr("*", f"coalesce(lag(_state) OVER ({line}), 0D) AS state")
        .where("_run >= 0")
        .drop("_block", "_total", "_bucket", "_local", "_closes", "_carry", "_state")
    )


def _value(i: int, m: Ewm, j: int) -> str:
    """Value of a row from its run and the state at the start of the run."""
    reached, started = f"_first{j} IS NOT NULL", f"_before{j} IS NOT NULL"
    if m.adjust:
        faded = f"exp(({POSITION} + 1) * -{m.nats!r}D)"
        num = f"(_num{i} + _state_num{i} * {faded})"
        den = f"(_den{i} + _state_den{i} * {faded})"
        return f"CASE WHEN {reached} OR {den} > {TINY!r}D THEN {num} / {den} ELSE _kept{i} END"
    share = f"coalesce({m.new_share(f'(_first{j} - _before{j})')}, 1D)"
    blended = f"((1 - {share}) * _state_sum{i} + {share} * _head{j})"
    return (
        f"CASE WHEN {reached} THEN exp(-_nats{i}) * {blended} + _sum{i}"
        f" WHEN {started} THEN _state_sum{i} END"
    )
