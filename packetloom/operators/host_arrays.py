"""The walk of ``host_state`` for many hosts at once, on arrays: no Python per flow.

Flows stand host by host, each host's in order of arrival, behind those of its earlier flows
that still count. A window is the range of places from its first flow to the flow itself; both
ends only move forward, so every flow enters and leaves once, and counts are running sums over
entries and departures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd

from packetloom.operators.windows import BEACON_TIMES
from packetloom.params import SECOND, Params

NAMES = ("capture", "host", "peer")   # of any type, also null
NUMBERS = ("port", "at", "syn", "failed", "new", "out", "into", "us")


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 0 and what they stand for; null is the first."""
    codes, names = pd.factorize(values)
    return codes + 1, np.concatenate([np.array([None], object), np.asarray(names, object)])


class _Groups:
    """Rows sorted by code, then by place."""

    def __init__(self, code: np.ndarray):
        self.order = np.argsort(code, kind="stable")
        ranked = code[self.order]
        self.first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.number = np.cumsum(self.first) - 1
        self.size = len(code)

    @cached_property
    def following(self) -> np.ndarray:
        """For each place the next one of its group, else the number of rows."""
        out = np.full(self.size, self.size)
        within = ~self.first[1:]
        out[self.order[:-1][within]] = self.order[1:][within]
        return out

    def dense(self) -> np.ndarray:
        out = np.empty(self.size, np.int64)
        out[self.order] = self.number
        return out


@dataclass
class _Span:
    """For each place the first one in its window, and the place at which it has left its own host's."""

    opens: np.ndarray

    def __post_init__(self):
        n = len(self.opens)
        self.leaves = np.cumsum(np.bincount(self.opens, minlength=n))
        self.size = np.arange(n) - self.opens + 1

    def total(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
        return sums[1:] - sums[self.opens]

    def distinct(self, groups: _Groups) -> np.ndarray:
        """A value counts from its latest flow on, until that leaves or another follows."""
        n = len(self.opens)
        over = np.minimum(groups.following, self.leaves)
        return np.arange(1, n + 1) - np.cumsum(np.bincount(over, minlength=n + 1))[:n]

    def most(self, groups: _Groups) -> np.ndarray:
        """Largest count of a group.

        A flow lifts its group to a count when it enters and takes that level away when it
        leaves; the largest count is the number of levels on which any group stands.
        """
        n, order = groups.size, groups.order
        key, rank = groups.number * (n + 1) + order, np.arange(n)
        edge = groups.number * (n + 1)
        entry = rank - np.searchsorted(key, edge + self.opens[order]) + 1
        departure = np.searchsorted(key, edge + self.leaves[order]) - rank
        level = np.concatenate([entry, departure])
        moment = np.concatenate([2 * order + 1, 2 * self.leaves[order]])  # departures come first
        by = np.argsort(level * (2 * n + 2) + moment, kind="stable")
        enters, step = by < n, moment[by] >> 1
        standing = np.cumsum(np.where(enters, 1, -1))
        up = np.bincount(step[enters & (standing == 1)], minlength=n + 1)
        down = np.bincount(step[~enters & (standing == 0)], minlength=n + 1)
        return np.cumsum(up - down)[:n]

    def largest(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Largest value in the windows of some places, from maxima over powers of two."""
        size = self.size[places]
        power = np.frexp(size.astype(np.float64))[1] - 1
        out, table = np.empty(len(places), values.dtype), values
        for k in range(int(power.max()) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.maximum(table[:-half], table[half:])
            now = np.flatnonzero(power == k)
            here = places[now]
            out[now] = np.maximum(table[self.opens[here]], table[here - (1 << k) + 1])
        return out


def _spans(host: np.ndarray, at: np.ndarray, *seconds: int) -> list[_Span]:
    """Windows reach back from the latest time that the host has seen; ``host`` ascends."""
    times, moment = np.unique(at, return_inverse=True)
    base = host * len(times)
    mark = np.maximum.accumulate(base + moment)
    latest = times[mark - base]
    return [_Span(np.searchsorted(mark, base + np.searchsorted(times, latest - s * SECOND)))
            for s in seconds]


@dataclass
class _Contacts:
    """Remembered contacts of the pairs: their number, capped, and where their memory began."""

    pairs: _Groups
    length: np.ndarray
    since: np.ndarray
    head: np.ndarray      # per rank

    @classmethod
    def of(cls, pairs: _Groups, span: _Span, held: np.ndarray, length: np.ndarray,
           since: np.ndarray) -> _Contacts:
        order, rank = pairs.order, np.arange(pairs.size)
        before = np.concatenate([[0], order[:-1]])
        # forgotten once the flow before showed that the last contact had left
        broke = pairs.first | (~held[order] & (span.leaves[before] < order))
        head = np.maximum.accumulate(np.where(broke, rank, 0))
        had = np.where(held, length, 1)[order]
        out_length, out_since = np.empty_like(rank), np.empty_like(rank)
        out_length[order] = np.minimum(BEACON_TIMES, rank - head + had[head])
        out_since[order] = since[order][head]
        return cls(pairs, out_length, out_since, head)

    def longest(self, span: _Span, places: np.ndarray) -> np.ndarray:
        """The latest flow of the pair remembered longest; of several the one known first."""
        bits = int(max(self.since.max(), self.pairs.size)).bit_length()
        if 2 * bits + 4 > 63:
            raise OverflowError("too many flows at once")
        early = (1 << bits) - 1 - self.since
        best = span.largest((self.length << (2 * bits)) | (early << bits) | np.arange(self.pairs.size), places)
        return best & ((1 << bits) - 1)

    def steadiness(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How even the positive gaps between the remembered times of a flow's pair are."""
        found, back = np.unique(places, return_inverse=True)
        out = np.zeros(len(found))
        some = np.flatnonzero(self.length[found] >= 4)   # three gaps
        if not some.size:
            return out[back]
        rank = np.empty(self.pairs.size, np.int64)
        rank[self.pairs.order] = np.arange(self.pairs.size)
        ago = np.minimum(np.arange(BEACON_TIMES), self.length[found[some], None] - 1)
        times = np.sort(at[self.pairs.order[rank[found[some], None] - ago]], axis=1)
        gaps = np.diff(times, axis=1).astype(np.float64)
        real = gaps > 0
        n = real.sum(axis=1)
        mean = gaps.sum(axis=1) / np.maximum(n, 1)
        spread = np.sqrt((np.where(real, gaps - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n, 1))
        enough = n >= 3
        out[some[enough]] = np.clip(1.0 - spread[enough] / mean[enough], 0.0, 1.0)
        return out[back]

    def alive(self, inside: np.ndarray) -> np.ndarray:
        """The last contacts of pairs that still have a flow inside."""
        order, rank = self.pairs.order, np.arange(self.pairs.size)
        last = np.concatenate([np.flatnonzero(self.pairs.first)[1:], [self.pairs.size]]) - 1
        end = last[self.pairs.number]
        out = np.empty(self.pairs.size, bool)
        out[order] = inside[order[end]] & (self.head == self.head[end]) & (end - rank < BEACON_TIMES)
        return out


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


class Hosts:
    """What the windows of some hosts hold, on the source or the destination side."""

    def __init__(self, p: Params, side: str, keep_s: int, held: dict[str, np.ndarray] | None = None):
        self.p, self.side, self.keep_s = p, side, keep_s
        self.held = held

    def observe(self, flows: dict[str, np.ndarray]) -> np.ndarray:
        """One row of features for each flow; the flows of a host stand in their order."""
        held, n = self.held, len(flows["at"])
        h = len(held["at"]) if held else 0
        code, named = {}, {}
        for name in NAMES:
            old = held[f"{name}_names"] if held else np.empty(0, object)
            codes, named[name] = coded(np.concatenate([old, flows[name]]))
            code[name] = np.concatenate([codes[:len(old)][held[name]], codes[len(old):]]) if held else codes
        host = code["capture"] * len(named["host"]) + code["host"]
        host = pd.factorize(host)[0]
        by = np.argsort(host, kind="stable")         # held flows come first
        host, was = host[by], by < h
        x = {c: (np.concatenate([held[c], flows[c]]) if held else flows[c])[by] for c in NUMBERS}
        peer = _Groups(host * len(named["peer"]) + code["peer"][by])
        ports, port_names = pd.factorize(x["port"])
        port = _Groups(host * len(port_names) + ports)
        here = np.flatnonzero(~was)
        if self.side == "dst":
            span, = _spans(host, x["at"], self.p.short_s)
            found = self._destination(span, x, peer)
        else:
            span, short = _spans(host, x["at"], self.p.long_s, self.p.short_s)
            pairs = _Groups(peer.dense() * len(port_names) + ports)
            pad = lambda c, rest: (np.concatenate([held[c], rest]) if held else rest)[by]
            since = pad("since", np.arange(n) + (int(held["since"].max()) + 1 if h else 0))
            contacts = _Contacts.of(pairs, span, was, pad("length", np.ones(n, np.int64)), since)
            found = self._source(span, short, x, peer, port, pairs)
            best = contacts.longest(span, here)
            found.insert(13, None)
        out = np.empty((n, len(found)))
        place = by[here] - h
        for i, f in enumerate(found):
            out[place, i] = contacts.steadiness(x["at"], best) if f is None else f[here]
        # what is inside at the end of each host, and contacts that its pairs remember
        final = np.append(host[1:] != host[:-1], True)
        inside = np.arange(len(host)) >= span.opens[final][np.cumsum(final) - final]
        keep = inside | contacts.alive(inside) if self.side == "src" else inside
        kept = {c: v[keep] for c, v in x.items()}
        for name in NAMES:
            kept[name], some = pd.factorize(code[name][by[keep]])
            kept[f"{name}_names"] = named[name][some]
        if self.side == "src":
            kept["length"] = contacts.length[keep]
            kept["since"] = np.unique(contacts.since[keep], return_inverse=True)[1]
        self.held = kept
        return out

    def _source(self, long: _Span, short: _Span, x: dict, peer: _Groups, port: _Groups,
                pairs: _Groups) -> list[np.ndarray]:
        """In HOST_FEATURES order, without the steadiness of contacts."""
        failed, sent, got, n = short.total(x["failed"]), long.total(x["out"]), long.total(x["into"]), long.size
        return [short.size, n, short.distinct(peer), long.distinct(peer), short.distinct(port),
                long.distinct(port), failed / self.p.short_s, _share(failed, short.total(x["syn"])),
                sent, got, sent / np.maximum(got, 1), _share(long.total(x["new"]), n),
                _share(long.total(x["us"]) / SECOND, n), long.most(pairs)]

    def _destination(self, span: _Span, x: dict, peer: _Groups) -> list[np.ndarray]:
        """In DST_FEATURES order."""
        failed = span.total(x["failed"])
        return [span.size, span.distinct(peer), failed / self.p.short_s, _share(failed, span.total(x["syn"]))]

    def _alarms(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each held flow's host, and the moment (ms) at which its windows are empty."""
        key = self.held["capture"] * len(self.held["host_names"]) + self.held["host"]
        host, hosts = pd.factorize(key)
        latest = np.zeros(len(hosts), np.int64)
        np.maximum.at(latest, host, self.held["at"])
        return host, latest // 1000 + self.keep_s * 1000 + 1

    def forget(self, before_ms: int) -> int | None:
        """Drop the hosts whose windows are empty by then; returns the next such moment."""
        if not self.held or not len(self.held["at"]):
            return None
        host, alarms = self._alarms()
        stays = (alarms >= before_ms)[host]
        if not stays.all():
            names = {f"{n}_names": self.held[f"{n}_names"] for n in NAMES}
            self.held = {c: v[stays] for c, v in self.held.items() if c not in names} | names
        return int(alarms[alarms >= before_ms].min()) if stays.any() else None
