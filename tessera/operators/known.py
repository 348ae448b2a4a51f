"""What is known of companies on each of their dates: a look-up in the versions of their facts, in numpy for many companies at once.

A version counts from its acceptance until a better one's, so on a company's dates in order it counts from one place to another. Each version meets the
dates that it counts on; single quarters, the quarter before each and the last of a series are then searches in one sorted array of keys (date, cell, end)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUARTERS = "array<struct<d:int,value:double,derived:boolean>>"
INSTANT = "struct<d:int,value:double>"
_DAY = 86_400_000_000
_NEVER = np.iinfo(np.int64).max
_LOW = -(2**40)
#: Dates that are looked up at once; a company's are not parted.
_AT_ONCE = 4096


@dataclass(frozen=True)
class Rules:
    """Cells by what is asked of them: instants and series of which the last is wanted, revenue in the order of preference, flows. quarter and year are
    bands of days; reach is how far before a state a period may end, stale the age of an end that is too old, most and least the quarters of a chain."""

    instants: tuple[int, ...]
    lasts: tuple[int, ...]
    revenue: tuple[int, ...]
    flows: tuple[int, ...]
    cells: int
    quarter: tuple[int, int]
    year: tuple[int, int]
    reach: int
    stale: int
    most: int = 9
    least: int = 8
    flow: int = 4


class _Series:
    """Values by date, cell and end, one each, in this order."""

    def __init__(self, group: np.ndarray, end: np.ndarray, width: int, first: int, value: np.ndarray, derived: np.ndarray | None = None):
        order = np.argsort(group * width + end)
        self.key, self.width, self.first = (group * width + end)[order], width, first
        self.value, self.derived = value[order], None if derived is None else derived[order]

    def day(self, at: np.ndarray) -> np.ndarray:
        return self.key[at] % self.width + self.first

    def before(self, key: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of the last key up to `key`, -1 where it is below `low`."""
        at = np.searchsorted(self.key, key, "right") - 1
        return np.where((at >= 0) & (self.key[at] >= low), at, -1) if len(self.key) else np.full(len(key), -1)

    def last(self, group: np.ndarray) -> np.ndarray:
        return self.before(group * self.width + self.width - 1, group * self.width)

    def ending(self, group: np.ndarray, end: np.ndarray, given: np.ndarray) -> np.ndarray:
        key = group * self.width + np.where(given, end - self.first, 0)
        return np.where(given, self.before(key, key), -1)


def _ints(column, null: int = 0) -> np.ndarray:
    kind = pa.int32() if pa.types.is_date(column.type) else pa.int64()
    return pc.fill_null(column.cast(kind).cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def _ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    rank = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    return rank[: len(a)], rank[len(a) :], len(rank) + 1


def _beyond(rising: np.ndarray, of: np.ndarray, value: np.ndarray, whose: np.ndarray) -> np.ndarray:
    """For each value the first date of its company with more than that; without one, where the next company's dates begin."""
    r, v, n = _ranked(rising, value)
    return np.searchsorted(of * n + r, whose * n + v, "right")


def _states(since: np.ndarray, whose: np.ndarray, until: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each date the last acceptance of its company before `until`, and whether there is one."""
    order = np.lexsort((since, whose))
    s, u, n = _ranked(since[order], until)
    at = np.searchsorted(whose[order] * n + s, of * n + u, "left") - 1
    there = (at >= 0) & (whose[order][at] == of) if len(order) else np.zeros(len(of), bool)
    return (since[order][at] if len(order) else until), there


def _single_quarters(group, q, end, value, there, width: int, first: int, band: tuple[int, int]) -> _Series:
    """What is reported for a quarter; else a total of n quarters less that of n - 1 ending a quarter before; the fewest quarters count at an end."""
    totals = _Series(group * 5 + q, end, width, first, np.arange(len(q)))
    key = (group * 5 + q - 1) * width + end
    base = totals.before(key - band[0], key - band[1])
    less = totals.value[base] if len(q) else base
    there = there & ((q == 1) | ((base >= 0) & there[less]))
    value = np.where(q == 1, value, value - value[less])
    i = np.flatnonzero(there)
    i = i[np.argsort((group[i] * width + end[i]) * 5 + q[i])]
    key = group[i] * width + end[i]
    i = i[np.concatenate([[True], key[1:] != key[:-1]])] if len(i) else i
    return _Series(group[i], end[i], width, first, value[i], q[i] > 1)


def _lists(chain: np.ndarray, of: _Series) -> pa.Array:
    there = chain >= 0
    at, n = chain[there], there.sum(1)
    x = pa.StructArray.from_arrays([pa.array(of.day(at).astype(np.int32)), pa.array(of.value[at]), pa.array(of.derived[at])], ["d", "value", "derived"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), x, mask=pa.array(n == 0))


def _points(at: np.ndarray, of: _Series) -> pa.Array:
    none = at < 0
    if none.all():
        return pa.nulls(len(at), pa.struct([("d", pa.int32()), ("value", pa.float64())]))
    return pa.StructArray.from_arrays([pa.array(of.day(at).astype(np.int32)), pa.array(of.value[at])], ["d", "value"], mask=pa.array(none))


def known(companies: pa.RecordBatch, rules: Rules) -> pa.RecordBatch:
    """companies (cik, dates, facts, filings) to one row a date: cik, the fields of the date, filed (the period of the last filing), _revenue (the cell that
    counts), _c (its chain), and by cell its instant (_x) or last quarter (_l), or the chains that end with revenue (_n) and a year before (_p)."""
    sizes = {c: _ints(pc.list_value_length(companies.column(c))) for c in ("dates", "facts", "filings")}
    asked, facts, filings = (companies.column(c).flatten() for c in sizes)
    of, whose, whose_filing = (np.repeat(np.arange(companies.num_rows), n) for n in sizes.values())
    day = _ints(pc.struct_field(asked, "day"))
    order = np.lexsort((day, of))
    day = day[order]
    end_of_day = (day + 1) * _DAY
    cell, d, q, since = (_ints(pc.struct_field(facts, c), -1) for c in ("cell", "d", "q", "known_from"))
    until = _ints(pc.struct_field(facts, "known_until"), _NEVER)
    v = pc.struct_field(facts, "v")
    there, v = v.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False)

    state, some = _states(since, whose, end_of_day, of)
    state = state // _DAY
    oldest = np.where(some, state - rules.reach, _LOW)
    year = (np.where(some, state, 0) + 366).astype("datetime64[D]").astype("datetime64[Y]")
    beyond = np.where(some, (year + 1).astype("datetime64[D]").astype(np.int64), _LOW)
    begin = np.maximum(_beyond(end_of_day, of, since, whose), _beyond(beyond, of, d, whose))
    stop = np.minimum(_beyond(end_of_day, of, until, whose), _beyond(oldest, of, d, whose))
    i = np.flatnonzero((cell >= 0) & (q >= 0) & (q <= 4) & (stop > begin))
    # ends are counted from so early that no band reaches into the next group of keys
    first = int(d[i].min()) - rules.quarter[1] - 1 if len(i) else 0
    width = int(d[i].max()) - first + 1 if len(i) else 1
    n = stop[i] - begin[i]
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[i], n)
    i = np.repeat(i, n)
    group = t * rules.cells + cell[i]

    k = (q[i] == 0) & there[i]
    instants = _Series(group[k], d[i][k] - first, width, first, v[i][k])
    k = q[i] > 0
    quarters = _single_quarters(group[k], q[i][k], d[i][k] - first, v[i][k], there[i][k], width, first, rules.quarter)
    earlier = quarters.before(quarters.key - rules.quarter[0], quarters.key - rules.quarter[1])
    at = np.arange(len(day)) * rules.cells

    def chain(start: np.ndarray, most: int) -> np.ndarray:
        out = np.full((len(start), most), -1)
        out[:, 0] = start
        for j in range(1, most if len(earlier) else 0):
            out[:, j] = np.where(out[:, j - 1] >= 0, earlier[out[:, j - 1]], -1)
        return out

    def ends(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (quarters.day(at) if len(quarters.key) else at), at >= 0

    revenue, chosen = np.full((len(day), rules.most), -1), np.full(len(day), -1)
    for c in rules.revenue:
        last = quarters.last(at + c)
        end, is_end = ends(last)
        x = chain(last, rules.most)
        use = (chosen < 0) & is_end & (day - end <= rules.stale) & (x[:, rules.least - 1] >= 0)
        revenue[use], chosen[use] = x[use], c
    end, is_end = ends(revenue[:, 0])
    ago, is_ago = ends(revenue[:, 4])
    is_ago = is_ago & (end - ago >= rules.year[0]) & (end - ago <= rules.year[1])

    out = {"cik": companies.column("cik").take(pa.array(of))}
    out |= {f.name: pc.struct_field(asked, f.name).take(pa.array(order)) for f in asked.type}
    filed, is_filed = np.array([], np.int64), np.zeros(len(day), bool)
    accepted = _ints(pc.struct_field(filings, "accepted"))
    a, e, n = _ranked(accepted, end_of_day)
    filed = np.searchsorted(whose_filing * n + a, of * n + e, "left") - 1
    is_filed = (filed >= 0) & (whose_filing[filed] == of) if len(accepted) else is_filed
    out["filed"] = pc.struct_field(filings, "period").take(pa.array(np.where(is_filed, filed, 0), mask=~is_filed))
    out["_revenue"] = pa.array(chosen.astype(np.int32), mask=chosen < 0)
    out["_c"] = _lists(revenue, quarters)
    out |= {f"_x{c}": _points(instants.last(at + c), instants) for c in rules.instants}
    out |= {f"_l{c}": _points(quarters.last(at + c), quarters) for c in rules.lasts}
    out |= {f"_n{c}": _lists(chain(quarters.ending(at + c, end, is_end), rules.flow), quarters) for c in rules.flows}
    out |= {f"_p{c}": _lists(chain(quarters.ending(at + c, ago, is_ago), rules.flow), quarters) for c in rules.flows}
    return pa.RecordBatch.from_pydict(out)


def fields(rules: Rules) -> str:
    """What known adds to the cik and the fields of a date."""
    points = [f"_{k}{c} {INSTANT}" for k, cells in (("x", rules.instants), ("l", rules.lasts)) for c in cells]
    return ", ".join(["filed date", "_revenue int", f"_c {QUARTERS}", *points, *[f"_{k}{c} {QUARTERS}" for k in "np" for c in rules.flows]])


def known_of(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        piece = np.cumsum(_ints(pc.list_value_length(batch.column("dates")))) // _AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield known(batch.slice(a, b - a), rules)
