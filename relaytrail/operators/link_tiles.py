"""Links of the forms of blocks, many pairs at a time.

Small blocks are scored as lists of pairs, many blocks in one call; a chunk of a popular block with another chunk
tile by tile. Element sets become 0/1 matrices and overlaps their products, so a pair of a tile costs some ten
nanoseconds in single precision: enough to tell which pairs can matter. Only those get the values of
``linkage.link_of``, to the last digit. Where the links that decide are asked for, a pair matters if it may be among the
strongest of one of its forms (forms come with a ``floor``, what their links reach already) or join two components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa

from relaytrail import fixed_values as fv

LOCI = tuple(fv.LOCUS_WEIGHTS)
TILE_ROWS, TILE_COLUMNS = 256, 1024
#: Rows of small blocks that are scored in one call, and pairs of one step of it.
SLICE_ROWS, SLICE_PAIRS = 2048, 200_000
LINK_SCHEMA = "org_id string, a_fid binary, b_fid binary, score double, " + ", ".join(f"sim_{k} double" for k in LOCI)
_SETS = ("i", "d", "p", "markers", "trigrams")
#: More than rounding to four decimals and single precision change in a score or a similarity.
_SLACK = 0.0005


def rounded(values: np.ndarray) -> np.ndarray:
    """Four decimals, half to even on the shortest decimal form, as Spark's ``bround``."""
    scaled = values * 1e4
    out = np.rint(scaled) / 1e4
    close = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if close.any():
        some, at = np.unique(values[close], return_inverse=True)
        exact = [float(Decimal(repr(float(v))).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) for v in some]
        out[close] = np.array(exact)[at]
    return out


def common_length(a: tuple, b: tuple) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Lists:
    """A column of arrays as lengths and the places of their elements."""

    def __init__(self, column: pa.Array) -> None:
        offsets = column.offsets.to_numpy()
        self.start = offsets[:-1] - offsets[0]
        self.size = np.diff(offsets)
        self.row = np.repeat(np.arange(len(column)), self.size)
        self.value = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]

    def tuples(self) -> list[tuple]:
        return [tuple(self.value[s : s + n].tolist()) for n, s in zip(self.size, self.start)]


class Side:
    """One side of a group: a row a form."""

    def __init__(self, table: pa.Table) -> None:
        whole = table.combine_chunks()
        column = lambda name: pa.concat_arrays(whole[name].chunks) if whole[name].num_chunks != 1 else whole[name].chunk(0)
        s = column("s")
        field = {s.type.field(i).name: part for i, part in enumerate(s.flatten())}
        self.rows = whole.num_rows
        self.fid = column("fid").to_pylist()
        self.known = np.array(column("known").to_pylist(), dtype=bool)
        self.lists = {k: Lists(field[k]) for k in (*_SETS, "order")} | {"earlier": Lists(column("earlier"))}
        self.there = ~np.array([field[k].is_null().to_numpy(zero_copy_only=False) for k in (*_SETS, "order")]).any(axis=0)
        self.code = {}
        for k in ("order_hash", "mailer", "msgid", "boundary", "tld", "simhash"):
            self.code[k] = (field[k].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), field[k].is_valid().to_numpy(zero_copy_only=False))
        self.features = field["features"].fill_null(-1).to_numpy(zero_copy_only=False)
        names = sorted(k for k in field if k[0] == "f" and k[1:].isdigit())
        self.f = [field[k].to_numpy(zero_copy_only=False) for k in names]
        self.norm = field["norm"].to_numpy(zero_copy_only=False)
        self.tie = field["tie"].to_pylist() if "tie" in field else self.fid
        self.floor = column("floor").fill_null(-1.0).to_numpy(zero_copy_only=False) if "floor" in whole.column_names else np.full(self.rows, -1.0)


class Pairs:
    """The forms of two sides (or of one with itself) and the values of their pairs."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        names = np.array(a.fid + ([] if b is a else b.fid), dtype="S32")
        _, codes = np.unique(names, return_inverse=True)
        self.a_code, self.b_code = codes[: a.rows], codes[-b.rows :]
        self.nodes = codes.max() + 1
        orders = [side.lists["order"].tuples() for side in (a, b)]
        self.orders = list(dict.fromkeys(orders[0] + orders[1]))
        at = {o: n for n, o in enumerate(self.orders)}
        self.a_order, self.b_order = (np.array([at[o] for o in side]) for side in orders)
        self.ratios: dict[int, float] = {}
        ties = a.tie + ([] if b is a else b.tie)
        _, tie = np.unique(np.array(ties, dtype=object), return_inverse=True)
        self.tie = np.empty(self.nodes, dtype=np.int64)
        self.tie[codes] = tie

    def ratio(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shares of the header order that pairs of orders have in common."""
        some, back = np.unique(x * len(self.orders) + y, return_inverse=True)
        for n in some.tolist():
            if n not in self.ratios:
                left, right = (self.orders[k] for k in divmod(n, len(self.orders)))
                self.ratios[n] = common_length(left, right) / max(len(left), len(right), 1)
        return np.array([self.ratios[n] for n in some.tolist()])[back]

    def links(self, r: np.ndarray, c: np.ndarray, common: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the accepted ones of these pairs, score, similarities); ``common``: how many elements of a set they share."""
        a, b = self.a, self.b

        def overlap(name: str) -> np.ndarray:
            shared = common(name).astype(np.float64)
            return shared / np.maximum(a.lists[name].size[r] + b.lists[name].size[c] - shared, 1)

        def same(name: str) -> np.ndarray:
            (u, u_there), (v, v_there) = a.code[name], b.code[name]
            return (u[r] == v[c]) & u_there[r] & v_there[c]

        t, w = fv.TOOLING_WEIGHTS, fv.LOCUS_WEIGHTS
        (u, u_there), (v, v_there) = a.code["simhash"], b.code["simhash"]
        near = np.where(u_there[r] & v_there[c], 1.0 - np.bitwise_count((u[r] ^ v[c]).view(np.uint64)) / 64.0, 0.0)
        # summed in this order: the last digit of a sum depends on it
        order = np.where(same("order_hash"), 1.0, self.ratio(self.a_order[r], self.b_order[c]))
        tooling = order * t["order"] + np.where(same("mailer"), t["mailer"], 0.0) + np.where(same("msgid"), t["msgid"], 0.0) + np.where(same("boundary"), t["boundary"], 0.0)
        dot = np.zeros(len(r))
        for f, g in zip(a.f, b.f):
            dot = dot + f[r] * g[c]
        norm = a.norm[r] * b.norm[c]
        cosine = np.where((a.features[r] != b.features[c]) | (norm == 0), 0.0, dot / np.where(norm == 0, 1.0, norm))
        naming = cosine * 0.4 + np.where(same("tld"), 0.2, 0.0) + overlap("trigrams") * 0.4
        raw = {"i": overlap("i"), "d": overlap("d"), "n": naming, "m": tooling, "c": near * 0.7 + overlap("markers") * 0.3, "p": overlap("p")}
        sims = {k: rounded(np.minimum(raw[k], 1.0)) for k in LOCI}
        total = np.zeros(len(r))
        for k in LOCI:
            total = total + sims[k] * w[k]
        score = rounded(total)
        agreeing = sum((sims[k] >= fv.LOCUS_AGREEMENT).astype(np.int8) for k in LOCI)
        strongest = np.maximum.reduce([sims[k] for k in fv.NON_CONTENT_LOCI])
        kept = np.nonzero((score >= fv.LINK_THRESHOLD) & (agreeing >= fv.MIN_AGREEING_LOCI) & (strongest >= fv.NON_CONTENT_THRESHOLD))[0]
        return kept, score[kept], np.array([sims[k][kept] for k in LOCI])

    def table(self, org: str, r: np.ndarray, c: np.ndarray, score: np.ndarray, sims: np.ndarray) -> pa.Table:
        a, b = np.array(self.a.fid, dtype=object), np.array(self.b.fid, dtype=object)
        arrays = [[org] * len(score), a[r], b[c], score, *sims]
        return pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(arrays, _LINKS)], schema=_LINKS)


_LINKS = pa.schema(
    [("org_id", pa.string()), ("a_fid", pa.binary()), ("b_fid", pa.binary()), ("score", pa.float64()), *[(f"sim_{k}", pa.float64()) for k in LOCI]]
)


class Forest:
    """Components of nodes as links join them."""

    def __init__(self, nodes: int) -> None:
        self.label = np.arange(nodes)

    def join(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Join the ends of links; True for those that made two components one."""
        joins = np.zeros(len(u), dtype=bool)
        apart = np.nonzero(self.label[u] != self.label[v])[0]
        while len(apart):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            p, q = self.label[u[apart]], self.label[v[apart]]
            some = np.unique(np.r_[np.unique(p, return_index=True)[1], np.unique(q, return_index=True)[1]])
            for n, x, y in zip(apart[some].tolist(), p[some].tolist(), q[some].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    joins[n] = True
            moved = np.arange(len(self.label))
            for x in list(parent):
                moved[x] = root(x)
            self.label = moved[self.label]
            apart = apart[self.label[u[apart]] != self.label[v[apart]]]
        return joins


class Group(Pairs):
    """The links of the forms of one side with those of the other, tile by tile.

    ``half``: both sides are chunks of one list, and each pair of chunks is a group once.
    """

    def __init__(self, a: Side, b: Side, half: bool) -> None:
        super().__init__(a, b)
        self.half = half
        (seen_a, a_seen), (seen_b, b_seen) = (np.unique(o, return_inverse=True) for o in (self.a_order, self.b_order))
        share = self.ratio(np.repeat(seen_a, len(seen_b)), np.tile(seen_b, len(seen_a)))
        self.order_share, self.a_seen, self.b_seen = share.reshape(len(seen_a), -1).astype(np.float32), a_seen, b_seen
        self.a_at, self.b_at = np.argsort(self.a_code, kind="stable"), np.argsort(self.b_code, kind="stable")
        self.elements = {}
        for name in (*_SETS, "earlier"):
            x, y = a.lists[name], b.lists[name]
            _, code = np.unique(np.r_[x.value, y.value], return_inverse=True)
            n = code.max() + 1 if len(code) else 0
            u, v = code[: len(x.value)], code[len(x.value) :]
            both = (np.bincount(u, minlength=n) > 0) & (np.bincount(v, minlength=n) > 0)
            new = np.cumsum(both) - 1
            self.elements[name] = (self._placed(x, u, both, new, self.a_at), self._placed(y, v, both, new, self.b_at), int(both.sum()))
        self.equal = {}
        for name in ("order_hash", "mailer", "msgid", "boundary", "tld"):
            (u, u_there), (v, v_there) = a.code[name], b.code[name]
            _, code = np.unique(np.r_[u, v], return_inverse=True)
            code = code.astype(np.int32)
            self.equal[name] = np.where(u_there, code[: a.rows], -1)[self.a_at], np.where(v_there, code[a.rows :], -2)[self.b_at]
        unit = lambda s: (np.stack(s.f, axis=1) / np.where(s.norm == 0, 1.0, s.norm)[:, None]).astype(np.float32)
        self.unit = unit(a)[self.a_at], unit(b)[self.b_at]
        counts = np.unique(np.r_[a.features[a.norm != 0], b.features[b.norm != 0]])
        self.mixed = len(counts) > 1

    @staticmethod
    def _placed(lists: Lists, code: np.ndarray, both: np.ndarray, new: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements that both sides have, in the order of the rows: (first of a row, row, element)."""
        place = np.empty(len(at), dtype=np.int64)
        place[at] = np.arange(len(at))
        use = both[code] if len(code) else np.zeros(0, dtype=bool)
        row, element = place[lists.row[use]], new[code[use]] if len(code) else code
        order = np.argsort(row, kind="stable")
        row, element = row[order], element[order]
        return np.searchsorted(row, np.arange(len(at) + 1)), row, element

    def tiles(self) -> Iterator["Tile"]:
        for i in range(0, self.a.rows, TILE_ROWS):
            for j in range(0, self.b.rows, TILE_COLUMNS):
                tile = Tile(self, i, min(i + TILE_ROWS, self.a.rows), j, min(j + TILE_COLUMNS, self.b.rows))
                if tile.once is not None:
                    yield tile

    def common(self, name: str, i: int, i2: int, j: int, j2: int) -> np.ndarray:
        """How many elements each row of a tile shares with each column."""
        (a_first, a_row, a_element), (b_first, b_row, b_element), n = self.elements[name]
        height, width = i2 - i, j2 - j
        x, xe = a_row[a_first[i] : a_first[i2]] - i, a_element[a_first[i] : a_first[i2]]
        y, ye = b_row[b_first[j] : b_first[j2]] - j, b_element[b_first[j] : b_first[j2]]
        in_rows, in_columns = np.bincount(xe, minlength=n), np.bincount(ye, minlength=n)
        pairs = in_rows * in_columns
        dense = pairs > height * width // 32
        if dense.any():
            at = np.cumsum(dense) - 1
            left, right = np.zeros((height, at[-1] + 1), dtype=np.float32), np.zeros((width, at[-1] + 1), dtype=np.float32)
            use, use_y = dense[xe], dense[ye]
            left[x[use], at[xe[use]]] = 1
            right[y[use_y], at[ye[use_y]]] = 1
            out = left @ right.T
        else:
            out = np.zeros((height, width), dtype=np.float32)
        rare = (pairs > 0) & ~dense
        if rare.any():
            use, use_y = rare[xe], rare[ye]
            order = np.argsort(ye[use_y], kind="stable")
            y, ye = y[use_y][order], ye[use_y][order]
            x, xe = x[use], xe[use]
            first, many = np.searchsorted(ye, xe), in_columns[xe]
            np.add.at(out.reshape(-1), np.repeat(x * width, many) + y[np.repeat(first, many) + _spread(many)], np.float32(1))
        return out


class Tile:
    """Some rows with some columns of a group: scores in single precision, exact values for what is asked for."""

    def __init__(self, group: Group, i: int, i2: int, j: int, j2: int) -> None:
        self.group, a, b = group, group.a, group.b
        self.rows, self.columns = group.a_at[i:i2], group.b_at[j:j2]
        self.box = box = (i, i2, j, j2)
        u, v = group.a_code[self.rows], group.b_code[self.columns]
        known = b.known[self.columns]
        self.once = None
        if group.half:
            once = np.ones((len(u), len(v)), dtype=bool)
        elif v[-1] <= u[0] and not known.any():
            return
        else:
            once = known[None, :] | (u[:, None] < v[None, :])
        once &= a.there[self.rows, None] & b.there[None, self.columns]
        if group.elements["earlier"][2]:
            once &= group.common("earlier", *box) == 0
        if not once.any():
            return
        self.once = once
        self.u, self.v = u, v
        self.counts = {name: group.common(name, *box) for name in _SETS}
        self.sims = self._similarities()
        self.score = sum(self.sims[k] * np.float32(w) for k, w in fv.LOCUS_WEIGHTS.items())
        self.score[~once] = -1

    def _similarities(self) -> dict[str, np.ndarray]:
        group, (i, i2, j, j2) = self.group, self.box
        a, b = group.a, group.b

        def overlap(name: str) -> np.ndarray:
            count = self.counts[name]
            n, m = a.lists[name].size[self.rows].astype(np.float32), b.lists[name].size[self.columns].astype(np.float32)
            both = n[:, None] + m[None, :]
            both -= count
            np.maximum(both, 1, out=both)
            return count / both

        def same(name: str) -> np.ndarray:
            x, y = group.equal[name]
            return x[i:i2, None] == y[None, j:j2]

        t = fv.TOOLING_WEIGHTS
        order = group.order_share[np.ix_(group.a_seen[self.rows], group.b_seen[self.columns])]
        order[same("order_hash")] = 1
        tooling = order * np.float32(t["order"])
        for name in ("mailer", "msgid", "boundary"):
            tooling += same(name) * np.float32(t[name])
        naming = group.unit[0][i:i2] @ group.unit[1][j:j2].T
        if group.mixed:
            naming *= a.features[self.rows, None] == b.features[None, self.columns]
        naming *= np.float32(0.4)
        naming += same("tld") * np.float32(0.2)
        naming += overlap("trigrams") * np.float32(0.4)
        (u, u_there), (v, v_there) = a.code["simhash"], b.code["simhash"]
        apart = np.bitwise_count(u[self.rows].view(np.uint64)[:, None] ^ v[self.columns].view(np.uint64)[None, :])
        content = (64 - apart).astype(np.float32)
        content *= np.float32(0.7 / 64)
        if not (u_there[self.rows].all() and v_there[self.columns].all()):
            content *= u_there[self.rows, None] & v_there[None, self.columns]
        content += overlap("markers") * np.float32(0.3)
        sims = {"i": overlap("i"), "d": overlap("d"), "n": naming, "m": tooling, "c": content, "p": overlap("p")}
        for k in ("n", "m", "c"):
            np.minimum(sims[k], 1, out=sims[k])
        return sims

    def gate(self, x: np.ndarray, y: np.ndarray, slack: float) -> np.ndarray:
        """Which pairs pass the gate besides the score, give or take ``slack``."""
        agreeing = sum((self.sims[k][x, y] >= fv.LOCUS_AGREEMENT + slack).astype(np.int8) for k in LOCI)
        strongest = np.maximum.reduce([self.sims[k][x, y] for k in fv.NON_CONTENT_LOCI])
        return (agreeing >= fv.MIN_AGREEING_LOCI) & (strongest >= fv.NON_CONTENT_THRESHOLD + slack)

    def exact(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(places, r, c, score, similarities) of the links among these pairs."""
        r, c = self.rows[x], self.columns[y]
        kept, score, sims = self.group.links(r, c, lambda name: self.counts[name][x, y])
        return kept, r[kept], c[kept], score, sims

    def all_links(self) -> tuple[np.ndarray, ...]:
        x, y = np.nonzero(self.score >= fv.LINK_THRESHOLD - _SLACK)
        return self.exact(x, y)[1:]

    def raise_floors(self, floor: np.ndarray, limit: int) -> None:
        """Forms with many pairs at their floor get the score of the ``limit``-th of the pairs that are links for sure."""
        for nodes, score, side in ((self.u, self.score, False), (self.v, self.score.T, True)):
            least = np.maximum(floor[nodes], fv.LINK_THRESHOLD).astype(np.float32) - np.float32(_SLACK)
            many = np.nonzero(np.count_nonzero(score >= least[:, None], axis=1) > 8 + 4 * limit)[0]
            if not len(many):
                continue
            some = score[many]
            x, y = np.nonzero(some >= least[many, None])
            sure = (some[x, y] >= fv.LINK_THRESHOLD + _SLACK) & (self.gate(y, many[x], _SLACK) if side else self.gate(many[x], y, _SLACK))
            held = np.full(some.shape, -1, dtype=np.float32)
            held[x[sure], y[sure]] = some[x[sure], y[sure]]
            if held.shape[1] >= limit:
                reached = np.partition(held, held.shape[1] - limit, axis=1)[:, held.shape[1] - limit]
                floor[nodes[many]] = np.maximum(floor[nodes[many]], reached.astype(np.float64) - _SLACK)

    def deciding(self, floor: np.ndarray, forest: Forest, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(r, c, score, similarities, joins) of the links that may be among the strongest of a form, or join components."""
        self.raise_floors(floor, limit)
        least = np.minimum(floor[self.u][:, None], floor[self.v][None, :]).astype(np.float32)
        np.maximum(least, fv.LINK_THRESHOLD, out=least)
        x, y = np.nonzero(self.score >= least - np.float32(_SLACK))
        open_ = self.gate(x, y, -_SLACK)
        x, y = x[open_], y[open_]
        if len(x):
            kept, r, c, score, sims = self.exact(x, y)
            yield r, c, score, sims, forest.join(self.u[x[kept]], self.v[y[kept]])
            self.score[x, y] = -1
        rounds = 0
        while True:
            p, q = forest.label[self.u], forest.label[self.v]
            if p.min() == q.max() and q.min() == p.max():
                return
            x, y = np.nonzero((self.score >= fv.LINK_THRESHOLD - _SLACK) & (p[:, None] != q[None, :]))
            open_ = self.gate(x, y, -_SLACK)
            x, y = x[open_], y[open_]
            if not len(x):
                return
            if rounds < 6:  # the first of each row and of each column, before all of them
                first = np.unique(np.r_[np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1]])
                x, y = x[first], y[first]
            rounds += 1
            kept, r, c, score, sims = self.exact(x, y)
            joins = forest.join(self.u[x[kept]], self.v[y[kept]])
            yield r[joins], c[joins], score[joins], sims[:, joins], joins[joins]
            self.score[x, y] = -1


def group_links(key: tuple, left: pa.Table, right: pa.Table, limit: int | None, chunked: bool) -> pa.Table:
    """The accepted links of a group of two chunks; with ``limit`` those that decide."""
    if not (left.num_rows and right.num_rows):
        return _LINKS.empty_table()
    org = key[0].as_py()
    group = Group(Side(left), Side(right), chunked and key[3].as_py() != key[4].as_py())
    if limit is None:
        parts = [group.table(org, *tile.all_links()) for tile in group.tiles()]
        return pa.concat_tables([_LINKS.empty_table(), *parts])
    forest, best = Forest(group.nodes), None
    floor = np.full(group.nodes, -1.0)
    floor[group.a_code], floor[group.b_code] = group.a.floor, group.b.floor
    for tile in group.tiles():
        found = list(tile.deciding(floor, forest, limit))
        if found:
            links = found if best is None else [best, *found]
            links = [np.concatenate(parts, axis=-1) for parts in zip(*links)]
            kept = _decisive(links, group, limit)
            best = [v[..., kept] for v in links]
    return _LINKS.empty_table() if best is None else group.table(org, *best[:4])


def _first_few(row: np.ndarray, tie: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Places of the ``limit`` strongest entries of every row."""
    best = np.full(row.max() + 1, -1.0)
    if limit == 1:
        np.maximum.at(best, row, score)
    some = np.nonzero(score >= best[row])[0]
    order = some[np.lexsort((tie[some], -score[some], row[some]))]
    ranked = row[order]
    start = np.r_[True, ranked[1:] != ranked[:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[place < limit]


def _decisive(links: list[np.ndarray], pairs: Pairs, limit: int) -> np.ndarray:
    """Places of the links that join components or are among the strongest of one of their forms."""
    r, c, score, _, joins = links
    if not len(r):
        return np.zeros(0, dtype=np.int64)
    # a form may be on both sides
    u, v = pairs.a_code[r], pairs.b_code[c]
    first = _first_few(np.r_[u, v], np.r_[pairs.tie[v], pairs.tie[u]], np.r_[score, score], limit) % len(r)
    kept = joins.copy()
    kept[first] = True
    return np.nonzero(kept)[0]


class Membership:
    """How many elements two rows share, for lists of pairs."""

    def __init__(self, lists: Lists) -> None:
        self.lists = lists
        _, code = np.unique(lists.value, return_inverse=True)
        self.code, self.n = code, int(code.max()) + 1 if len(code) else 0
        self.small = len(lists.size) * self.n <= 1 << 24
        if self.small:
            self.has = np.zeros((len(lists.size), max(self.n, 1)), dtype=bool)
            self.has[lists.row, code] = True
        else:
            self.has = np.unique(lists.row * self.n + code)

    def common(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        size = self.lists.size[r]
        element = self.code[np.repeat(self.lists.start[r], size) + _spread(size)]
        pair, other = np.repeat(np.arange(len(r)), size), np.repeat(c, size)
        if self.small:
            hit = self.has[other, element]
        elif len(element):
            want = other * self.n + element
            hit = self.has[np.minimum(np.searchsorted(self.has, want), len(self.has) - 1)] == want
        else:
            hit = np.zeros(0, dtype=bool)
        return np.bincount(pair[hit], minlength=len(r))


def _slice_links(org: str, block: np.ndarray, table: pa.Table, limit: int | None) -> Iterator[pa.Table]:
    """The links within the blocks of a slice; ``block``: the number of each row's block, never decreasing."""
    side = Side(table)
    pairs, sets = Pairs(side, side), {name: Membership(side.lists[name]) for name in (*_SETS, "earlier")}
    ends = np.searchsorted(block, block, side="right")
    later = ends - np.arange(len(block)) - 1
    cuts = np.searchsorted(np.cumsum(later), np.arange(SLICE_PAIRS, later.sum() + SLICE_PAIRS, SLICE_PAIRS))
    forest, best, start = Forest(pairs.nodes), None, 0
    for stop in np.unique(np.minimum(cuts + 1, len(block))):
        row = np.arange(start, stop)
        start = stop
        r = np.repeat(row, later[row])
        c = r + 1 + _spread(later[row])
        use = ~(side.known[r] & side.known[c]) & side.there[r] & side.there[c]
        r, c = r[use], c[use]
        once = sets["earlier"].common(r, c) == 0
        r, c = r[once], c[once]
        if not len(r):
            continue
        kept, score, sims = pairs.links(r, c, lambda name: sets[name].common(r, c))
        r, c = r[kept], c[kept]
        if limit is None:
            yield pairs.table(org, r, c, score, sims)
        elif len(r):
            links = [r, c, score, sims, forest.join(pairs.a_code[r], pairs.b_code[c])]
            links = links if best is None else [np.concatenate(parts, axis=-1) for parts in zip(best, links)]
            best = [v[..., _decisive(links, pairs, limit)] for v in links]
    if best is not None:
        yield pairs.table(org, *best[:4])


def small_block_links(limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of rows sorted by (org_id, dna_version, key): the links within each block, with ``limit`` those that decide.

    A row has every block its form shares with others before this one in ``earlier``, so a pair is met in the
    first of its blocks alone.
    """
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of whole blocks of one organisation."""
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part in (batch.slice(n, SLICE_ROWS) for n in range(0, batch.num_rows, SLICE_ROWS)):
                held.append(pa.Table.from_batches([part]))
                rows += part.num_rows
                if rows < SLICE_ROWS:
                    continue
                table = pa.concat_tables(held)
                starts = np.nonzero(_starts(table, ("org_id", "dna_version", "key")))[0]
                if starts[-1]:
                    yield table.slice(0, starts[-1])
                held, rows = [table.slice(starts[-1])], table.num_rows - starts[-1]
        if rows:
            yield pa.concat_tables(held)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            orgs = np.r_[np.nonzero(_starts(table, ("org_id",)))[0], table.num_rows]
            block = np.cumsum(_starts(table, ("org_id", "dna_version", "key")))
            for first, end in zip(orgs[:-1].tolist(), orgs[1:].tolist()):
                for found in _slice_links(table["org_id"][first].as_py(), block[first:end], table.slice(first, end - first), limit):
                    yield from found.to_batches()

    return links


def _starts(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """True where a row differs from the one before in one of the columns."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[0] = True
    for name in names:
        at = pa.concat_arrays(table[name].chunks).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out[1:] |= at[1:] != at[:-1]
    return out
