"""Suffix-array dedup of byte strings by longest previous factors, in shards by content.

Every string of LENGTH bytes is dealt by its anchor: the K bytes of the smallest hash
inside it (its leftmost minimizer). Equal strings have equal anchors at equal places, so
all copies of a string meet in one shard. There the suffixes of the shard's segments are put
in order, with what neighbours share; the nearest smaller places before and after each in that
order give its longest previous factor, and strings whose factor is LENGTH long go. A segment
is the stretch of text whose strings share one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazewatch.llm.blocks import bucket_rows, by_group, in_blocks, joined, table_of
from gazewatch.llm.common import partitions
from gazewatch.llm.hashing import Prefixes, among, mixed
from gazewatch.llm.window_dedup import _arrow_type, _known, _pairs, _replies, _schema

LENGTH = 200
#: Bytes of an anchor.
K = 64
#: Starts of strings that one pass of the hashing kernel covers.
PART = 250_000
#: A shard sorts the suffixes of so many bytes at a time.
SORTED_BYTES = 500_000
#: Anchors with more segments than this go by their single strings instead.
HOT_SEGMENTS = 4096

HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


# --- suffix order and previous factors -------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The dense rank of each key, in 32 bits: a shard's part has fewer bytes than that."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    steps = np.zeros(len(keys), dtype=np.int32)
    np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
    ranks = np.empty(len(keys), dtype=np.int32)
    ranks[order] = steps
    return ranks


def _paired(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low


class Suffixes:
    """The suffixes of some bytes at `starts` (ascending), in order of their first `length` bytes.

    `length` is 8 or more. `order` has indices of `starts`, equal suffixes by place. Prefix
    doubling: ranks by 8 bytes, then by 16, 32 and so on; the length is the sum of some of
    these, and only the starts are sorted by that sum. The same ranks tell how long
    neighbours agree.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.starts, self.length = starts, length
        self.bytes = padded = np.concatenate((data, np.zeros(length + 8, dtype=np.uint8)))
        n = len(padded) - 8
        keys = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            keys = (keys << np.uint64(8)) | padded[i : i + n]
        self.levels, size = {8: _ranks(keys)}, 8
        while 2 * size <= length:
            ranks = self.levels[size]
            pairs = ranks.astype(np.int64) << 32
            pairs[: n - size] |= ranks[size:] + 1
            size *= 2
            self.levels[size] = _ranks(pairs)
        done, rank = 0, np.zeros(len(starts), dtype=np.int32)
        for size in sorted(self.levels, reverse=True):
            while done + size <= length:
                rank = _ranks(_paired(rank, self.levels[size][starts + done]))
                done += size
        if done < length:
            rank = _ranks(_paired(rank, self.levels[8][starts + length - 8]))
        self.order = np.argsort(rank, kind="stable")

    def common(self) -> np.ndarray:
        """For each suffix in order how many bytes, `length` at most, it shares with the one before."""
        at = self.starts[self.order]
        shared = np.zeros(len(at), dtype=np.int32)
        a, b, own = at[:-1], at[1:], shared[1:]
        for size in sorted(self.levels, reverse=True):
            more = np.arange(len(own))
            while len(more):
                more = more[own[more] + size <= self.length]
                rank, done = self.levels[size], own[more]
                more = more[rank[a[more] + done] == rank[b[more] + done]]
                own[more] += size
        more = np.arange(len(own))
        while len(more):  # the last few bytes one by one
            more = more[own[more] < self.length]
            more = more[self.bytes[a[more] + own[more]] == self.bytes[b[more] + own[more]]]
            own[more] += 1
        return shared


def previous_smaller(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value where the nearest smaller one before it is (-1: nowhere), and the least of
    `shared` from there on to it; `shared` is between a value and the one before.

    Pointer jumping: a pointer to a larger value goes on to where that one's pointer leads,
    for all values at once.
    """
    at = np.arange(-1, len(values) - 1, dtype=np.int32)
    least = shared.copy()
    open_ = np.flatnonzero((at >= 0) & (values[at] > values))
    while len(open_):
        over = at[open_]
        least[open_], at[open_] = np.minimum(least[open_], least[over]), at[over]
        open_ = open_[(at[open_] >= 0) & (values[at[open_]] > values[open_])]
    least[at < 0] = 0
    return at, least


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start how many bytes, `length` at most, also stand at an earlier start, and the
    index of such a start (-1: none).

    The longest previous factor of a suffix is shared with the nearest smaller place before or
    after it in suffix order, whichever shares more.
    """
    suffixes = Suffixes(data, starts, length)
    order, shared = suffixes.order.astype(np.int32), suffixes.common()
    del suffixes  # its ranks are the largest part by far
    before, with_before = previous_smaller(order, shared)
    after, with_after = previous_smaller(order[::-1], np.concatenate(([0], shared[1:][::-1]))[: len(order)])
    after, with_after = len(order) - 1 - after[::-1], with_after[::-1]  # -1 becomes len(order)
    later = with_after > with_before
    factor, source = np.zeros(len(starts), dtype=np.int32), np.full(len(starts), -1, dtype=np.int64)
    factor[order] = np.where(later, with_after, with_before)
    found = np.where(later, after, before)
    some = factor[order] > 0
    source[order[some]] = order[found[some]]
    return factor, source


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the index of an earlier start of the same `length` bytes, or -1: starts
    whose longest previous factor is that long."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    factor, source = longest_previous_factors(data, starts, length)
    return np.where(factor >= length, source, -1)


# --- segments --------------------------------------------------------------------------


class Segments:
    """The segments of some texts laid end to end: [a, b + length) holds the strings from a to b.

    `limits` are the places where the texts begin, and the end. Strings of one segment have
    their anchor at different offsets, so they all differ.
    """

    def __init__(self, data: np.ndarray, limits: np.ndarray, length: int, k: int):
        self.hashes, self.length = Prefixes(data), length
        kgrams = self.hashes.every(k)
        places = np.arange(len(kgrams), dtype=np.uint64)
        lows = _sliding_min((kgrams & HIGH) | places, length - k + 1)
        owner = (lows & LOW).astype(np.int64)
        #: Strings that would run over the end of a text.
        self.over = np.zeros(len(owner) + length, dtype=bool)
        for i in range(len(limits) - 1):
            self.over[max(limits[i], limits[i + 1] - length + 1) : limits[i + 1]] = True
        self.over = self.over[: len(owner)]
        owner[self.over] = -1
        edge = by_group(owner)
        kept = owner[edge[:-1]] >= 0
        self.a, self.b = edge[:-1][kept], edge[1:][kept] - 1
        at = owner[self.a]
        self.anchor = kgrams[at]
        self.offset = (at - self.a).astype(np.uint64)
        self.name = mixed(self.hashes.runs(self.a, self.b + length) ^ mixed(self.offset + np.uint64(1)))


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: suffix minima of one tile, prefix minima of the next."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    tiles = -(-len(keys) // width)
    full = np.full(tiles * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(keys)] = keys
    full = full.reshape(tiles, width)
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(full, axis=1).ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


class Block:
    """The texts of a block, in the order of documents, and their segments part by part."""

    def __init__(self, rows: pa.Table, length: int, k: int):
        self.length, self.k = length, k
        texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
        ids = rows.column("doc_id").to_pylist()
        digests = rows.column("digest").to_pylist()
        #: Documents go by id, those without one last, equal ids by digest.
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, digests[i]))
        self.texts = texts
        self.keys = [
            (np.iinfo(np.int64).max if ids[i] is None else int(ids[i]), digests[i]) for i in range(len(texts))
        ]

    def parts(self) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, Segments]]:
        """[(document, offset), ...], where each begins and the end, bytes, segments.

        Short texts share a part; a long text's parts overlap by length - 1 bytes.
        """
        held: list[tuple[int, int, int]] = []
        size = 0
        for i in self.order:
            n = len(self.texts[i])
            for offset in range(0, n - self.length + 1, PART):
                piece = (i, offset, min(n, offset + PART + self.length - 1))
                if held and size + piece[2] - offset > PART:
                    yield self._part(held)
                    held, size = [], 0
                held.append(piece)
                size += piece[2] - offset
        if held:
            yield self._part(held)

    def _part(self, held: list[tuple[int, int, int]]):
        data = np.frombuffer(b"".join([self.texts[i][a:b] for i, a, b in held]), dtype=np.uint8)
        limits = np.concatenate(([0], np.cumsum([b - a for _, a, b in held])))
        return [(i, a) for i, a, _ in held], limits, data, Segments(data, limits, self.length, self.k)


def _first_of_each(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct names in order: the first place of each, and whether there are several."""
    _, first, counts = np.unique(names, return_index=True, return_counts=True)
    return first, counts > 1


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    keep_first: bool = False,
    whole_chars: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    k: int = K,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed and n_spans of every row.

    A byte goes if a string of `length` bytes covers it that also starts elsewhere, in
    another row or in the same one. With `keep_first`, only strings with an earlier match go
    (by ascending doc_id, then place; rows without doc_id last), so the first copy stays.
    Columns named in `carry` come along. With `whole_chars`, a removed stretch shrinks to whole characters and `kept` is valid
    UTF-8. Strings are those of the input. Null, empty and shorter texts lose nothing.
    doc_id is an integer or null; identical rows are places like any others.

    Three passes read one exchange of the texts by block: anchors of segments go to buckets,
    then each block's distinct segments with a repeated anchor go to the shard of that
    anchor, and the starts found there come back. Copies within a block go once, so a
    passage in a third of all rows costs a shard one segment per block. An anchor with too
    many different segments for one sort sends its single strings as 96-bit hashes instead.
    """
    buckets = partitions(docs.sparkSession)
    blocks = in_blocks(docs, doc_id, text, digest=True, carry=carry)
    id_type = docs.schema[doc_id].dataType.simpleString()
    sent, sent_arrow = _schema(bucket="int", block="int", keys="binary", counts="binary", twice="binary")
    reply, reply_arrow = _schema(block="int", keys="binary", hot="binary")
    seg, seg_arrow = _schema(
        bucket="int", block="int", anchors="binary", names="binary", doc="binary", digest="binary", place="binary",
        twice="binary", sizes="binary", data="binary", strings="binary", checks="binary",
    )
    answer, answer_arrow = _schema(
        block="int", names="binary", own="binary", runs="binary", spans="binary", strings="binary", checks="binary",
        first="binary",
    )

    def send_anchors(rows: pa.Table) -> pa.Table:
        found = [(s.anchor, s.name) for *_, s in Block(rows, length, k).parts()]
        if not found:
            return table_of([], sent_arrow)
        anchors, names = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort((names, anchors))
        anchors, names = anchors[order], names[order]
        edge = by_group(anchors)
        new = np.concatenate(([True], names[1:] != names[:-1])).astype(np.int64)
        new[edge[:-1]] = 1
        counts = np.add.reduceat(new, edge[:-1]).astype(np.uint32)
        block = rows.column("block")[0].as_py()
        return table_of(
            list(bucket_rows(block, buckets, anchors[edge[:-1]], counts, np.diff(edge) > 1)), sent_arrow
        )

    def repeated_anchors(rows: pa.Table) -> pa.Table:
        keys, source = joined(rows.column("keys"), "<u8")
        counts, _ = joined(rows.column("counts"), "<u4")
        twice, _ = joined(rows.column("twice"), "?")
        order = np.argsort(keys, kind="stable")
        edge = by_group(keys[order])
        sizes = np.diff(edge)
        several = (sizes > 1) | np.logical_or.reduceat(twice[order], edge[:-1])
        hot = np.add.reduceat(counts[order].astype(np.int64), edge[:-1]) > hot_segments
        return _replies(
            rows, source[order], np.repeat(several, sizes), reply_arrow, keys[order], np.repeat(hot, sizes)
        )

    def send_segments(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return table_of([], seg_arrow)
        known, _ = joined(anchors.column("keys"), "<u8")
        hot, _ = joined(anchors.column("hot"), "?")
        known, hot = np.sort(known), np.sort(known[hot])
        block = Block(rows, length, k)
        kept: list[tuple] = []
        data: dict[int, bytes] = {}
        strings: list[tuple[np.ndarray, np.ndarray]] = []
        for pieces, limits, text_part, s in block.parts():
            owners, offsets = np.array(pieces, dtype=np.int64).T
            chosen = np.flatnonzero(among(s.anchor, known))
            if len(hot):
                warm = among(s.anchor[chosen], hot)
                if warm.any():
                    starts = _starts(s.a[chosen[warm]], s.b[chosen[warm]])
                    of = np.searchsorted(limits, starts, "right") - 1
                    strings.append((*_strings(s, starts), owners[of], starts - limits[of] + offsets[of]))
                    chosen = chosen[~warm]
            whole = text_part.tobytes()
            of = np.searchsorted(limits, s.a[chosen], "right") - 1
            at = s.a[chosen] - limits[of] + offsets[of]
            for a, b, anchor, name, doc, place in zip(
                *[x.tolist() for x in (s.a[chosen], s.b[chosen], s.anchor[chosen], s.name[chosen], owners[of], at)],
                strict=True,
            ):
                if name not in data:
                    data[name] = whole[a : b + length]
                    kept.append((anchor, name, *block.keys[doc], place, 0))
                else:
                    kept.append((anchor, name, 0, 0, 0, 1))
        out, number = [], rows.column("block")[0].as_py()
        if kept:
            anchor, name, doc, digest, place, _ = [
                np.array(x, dtype=t)
                for x, t in zip(zip(*kept, strict=True), ("<u8", "<u8", "<i8", "<i8", "<i8", "<i8"), strict=True)
            ]
            first, twice = _first_of_each(name)
            at = (anchor[first] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            first, twice, at = first[order], twice[order], at[order]
            edge = by_group(at)
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                f = first[x:y]
                stretches = [data[n] for n in name[f].tolist()]
                sizes = np.array([len(d) for d in stretches], dtype="<u4")
                out.append(
                    (int(at[x]), number, *[c[f].tobytes() for c in (anchor, name, doc, digest, place)],
                     twice[x:y].tobytes(), sizes.tobytes(), b"".join(stretches), b"", b"")
                )
        if strings:
            h, c, owner, at = [np.concatenate(x) for x in zip(*strings, strict=True)]
            order = np.lexsort((c, h))  # stable: the first of equals is the first in the block
            edge = by_group(_pairs(h[order], c[order]))
            first, twice = order[edge[:-1]], np.diff(edge) > 1
            doc, digest = np.array(block.keys, dtype=np.int64)[owner[first]].T
            columns = (c[first], doc, digest, at[first].astype(np.int64), twice)
            for bucket, _, keys, checks, d, g, p, several in bucket_rows(number, buckets, h[first], *columns):
                out.append((bucket, number, b"", b"", d, g, p, several, b"", b"", keys, checks))
        return table_of(out, seg_arrow)

    def factors(rows: pa.Table) -> pa.Table:
        columns = [joined(rows.column(c), t) for c, t in (("anchors", "<u8"), ("names", "<u8"), ("doc", "<i8"), ("digest", "<i8"), ("place", "<i8"), ("sizes", "<u4"))]
        anchor, name, doc, digest, place, sizes = [c for c, _ in columns]
        source = columns[0][1]
        blocks_of = np.array(rows.column("block").to_pylist(), dtype=np.int64)
        twice, flag_source = joined(rows.column("twice"), "?")
        # A row of the exchange holds either segments or single strings.
        of_segments = np.array([len(x) > 0 for x in rows.column("data").to_pylist()], dtype=bool)
        pick = lambda wanted: of_segments[flag_source] == wanted
        string_keys = [x[pick(False)] for x in (doc, digest, place, twice)]
        doc, digest, place, twice = [x[pick(True)] for x in (doc, digest, place, twice)]
        out: dict[int, list] = {}
        if len(name):
            bytes_of = b"".join(rows.column("data").to_pylist())
            begins = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
            order = np.lexsort((place, digest, doc, name, anchor))
            edge = by_group(name[order])
            heads = order[edge[:-1]]
            copied = (np.diff(edge) > 1) | np.logical_or.reduceat(twice[order], edge[:-1])
            earlier, matched = _factors_of(heads, anchor, doc, digest, place, begins, sizes, bytes_of)
            owners = np.repeat(np.arange(len(heads)), np.diff(edge))
            for i, g in zip(order.tolist(), owners.tolist(), strict=True):
                own = i == heads[g]
                if keep_first:
                    runs = earlier[g] if own else None
                else:
                    runs = None if copied[g] else matched[g]
                if runs is None or len(runs) or keep_first and copied[g]:
                    out.setdefault(int(blocks_of[source[i]]), []).append((name[i], runs is None, runs))
        answers = []
        for number, found in out.items():
            all_runs = [r if r is not None else np.zeros((0, 2), dtype="<u2") for _, _, r in found]
            answers.append(
                (number, np.array([n for n, _, _ in found], dtype="<u8").tobytes(),
                 np.array([not every for _, every, _ in found], dtype="?").tobytes(),
                 np.array([len(r) for r in all_runs], dtype="<u2").tobytes(),
                 np.concatenate(all_runs).astype("<u2").tobytes(), b"", b"", b"")
            )
        h, string_source = joined(rows.column("strings"), "<u8")
        if len(h):
            answers += _string_answers(rows, h, blocks_of[string_source], *string_keys)
        return table_of(answers, answer_arrow)

    def _factors_of(heads, anchor, doc, digest, place, begins, sizes, bytes_of):
        """Runs of starts, per head, with an earlier match and with any match.

        The strings of a segment differ, and equal strings share their anchor. So the only
        segment of an anchor has no match but its own copies, and is not sorted.
        """
        earlier = [np.zeros((0, 2), dtype="<u2")] * len(heads)
        matched = list(earlier)
        edge = by_group(anchor[heads])
        several = np.flatnonzero(np.repeat(np.diff(edge) > 1, np.diff(edge)))
        own_earlier, own_matched = _sorted_factors(heads[several], anchor, doc, digest, place, begins, sizes, bytes_of)
        for i, x, y in zip(several.tolist(), own_earlier, own_matched, strict=True):
            earlier[i], matched[i] = x, y
        return earlier, matched

    def _sorted_factors(heads, anchor, doc, digest, place, begins, sizes, bytes_of):
        earlier = [np.zeros((0, 2), dtype="<u2")] * len(heads)
        matched = list(earlier)
        ends = np.cumsum(sizes[heads].astype(np.int64))
        groups = by_group(anchor[heads])
        low = 0
        while low < len(groups) - 1:
            high = low + 1
            base = ends[groups[low] - 1] if groups[low] else 0
            while high < len(groups) - 1 and ends[groups[high + 1] - 1] - base <= SORTED_BYTES:
                high += 1
            part = np.arange(groups[low], groups[high])
            low = high
            h = heads[part]
            part = part[np.lexsort((place[h], digest[h], doc[h]))]
            h = heads[part]
            data = np.frombuffer(b"".join([bytes_of[begins[i] : begins[i] + sizes[i]] for i in h]), dtype=np.uint8)
            size = sizes[h].astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            counts = size - length + 1
            owner = np.repeat(np.arange(len(h)), counts)
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            source = previous_factors(data, begin[owner] + inner, length)
            has = source >= 0
            either = has.copy()
            either[source[has]] = True
            for flags, into in ((has, earlier), (either, matched)):
                for g, runs in _runs_by_owner(flags, owner, inner):
                    into[part[g]] = runs
        return earlier, matched

    def _string_answers(rows, h, from_block, doc, digest, place, twice):
        """To each block, its strings with another place, and which of them it has first."""
        c, _ = joined(rows.column("checks"), "<u4")
        order = np.lexsort((place, digest, doc, c, h))
        h, c, from_block = h[order], c[order], from_block[order]
        edge = by_group(_pairs(h, c))
        several = (np.diff(edge) > 1) | np.logical_or.reduceat(twice[order], edge[:-1])
        first = np.zeros(len(h), dtype=bool)
        first[edge[:-1]] = True
        chosen = np.flatnonzero(np.repeat(several, np.diff(edge)))
        for number in np.unique(from_block[chosen]).tolist():
            mine = chosen[from_block[chosen] == number]
            yield (number, b"", b"", b"", b"", h[mine].tobytes(), c[mine].tobytes(), first[mine].tobytes())

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of([], kept_arrow)
        names, _ = joined(answers.column("names"), "<u8")
        own, _ = joined(answers.column("own"), "?")
        runs, _ = joined(answers.column("runs"), "<u2")
        spans, _ = joined(answers.column("spans"), "<u2")
        spans = spans.reshape(-1, 2).astype(np.int64)
        limits_of = np.concatenate(([0], np.cumsum(runs.astype(np.int64))))
        order = np.argsort(names, kind="stable")
        sorted_names = names[order]
        strings, _ = joined(answers.column("strings"), "<u8")
        checks, _ = joined(answers.column("checks"), "<u4")
        by_hash = np.lexsort((checks, strings))
        strings, checks = strings[by_hash], checks[by_hash]
        first = joined(answers.column("first"), "?")[0][by_hash]
        block = Block(rows, length, k)
        gone = [None] * rows.num_rows
        own = own.copy()
        for pieces, limits, text_part, s in block.parts():
            marks = np.zeros(len(text_part) + 1, dtype=np.int32)
            hit = np.flatnonzero(among(s.name, sorted_names))
            at = order[np.searchsorted(sorted_names, s.name[hit])]
            partly = own[at]
            if keep_first:  # only the first place of a segment in its first block
                _, once = np.unique(at, return_index=True)
                partly = np.zeros(len(at), dtype=bool)
                partly[once] = own[at[once]]
                own[at[once]] = False
            np.add.at(marks, s.a[hit[~partly]], 1)
            np.add.at(marks, s.b[hit[~partly]] + length, -1)
            at, begin = at[partly], s.a[hit[partly]]
            counts = limits_of[at + 1] - limits_of[at]
            span = spans[_starts(limits_of[at], limits_of[at + 1] - 1)]
            first_start = np.repeat(begin, counts) + span[:, 0]
            np.add.at(marks, first_start, 1)
            np.add.at(marks, first_start + span[:, 1] - 1 + length, -1)
            if len(strings):
                h, c = _strings(s, np.arange(len(s.over)))
                starts = np.flatnonzero(among(h, strings) & ~s.over)
                starts = starts[_known(h[starts], c[starts], strings, checks)]
                if keep_first:
                    at = _position(h[starts], c[starts], strings, checks)
                    _, once = np.unique(at, return_index=True)
                    once = once[first[at[once]]]
                    stays = np.zeros(len(starts), dtype=bool)
                    stays[once] = True
                    first[at[once]] = False  # its first place is past
                    starts = starts[~stays]
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + length, -1)
            if marks.any():
                lost = np.cumsum(marks)[:-1] > 0
                for (doc, offset), x, y in zip(pieces, limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                    if lost[x:y].any():
                        if gone[doc] is None:
                            gone[doc] = np.zeros(len(block.texts[doc]), dtype=bool)
                        gone[doc][offset : offset + y - x] |= lost[x:y]
        out = []
        for text_bytes, lost in zip(block.texts, gone, strict=True):
            if lost is None:
                out.append((text_bytes, len(text_bytes), 0, 0))
                continue
            data = np.frombuffer(text_bytes, dtype=np.uint8)
            if whole_chars:
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                lost = np.repeat(np.logical_and.reduceat(lost, heads), np.diff(np.append(heads, len(data))))
            n_spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if len(lost) else 0
            out.append((data[~lost].tobytes(), len(data), int(lost.sum()), n_spans))
        kept = table_of(out, pa.schema(list(kept_arrow)[1 + len(carry) :]))
        for c in reversed(["doc_id", *carry]):
            kept = kept.add_column(0, c, rows.column(c))
        return kept

    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    kept_arrow = pa.schema(
        [("doc_id", _arrow_type(docs, doc_id)), *[(c, _arrow_type(docs, c)) for c in carry], ("kept", pa.binary()), ("n_bytes", pa.int64()),
         ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    )
    anchors = blocks.groupBy("block").applyInArrow(send_anchors, sent)
    anchors = anchors.groupBy("bucket").applyInArrow(repeated_anchors, reply)
    segments = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send_segments, seg)
    answers = segments.groupBy("bucket").applyInArrow(factors, answer)
    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(remove, f"doc_id {id_type}, {carried}kept binary, n_bytes long, n_removed long, n_spans long")
    )


def _starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    counts = b - a + 1
    return np.repeat(a, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _strings(s: Segments, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the strings at `starts`; the second mixes those of their two halves."""
    h = s.hashes.runs(starts, starts + s.length)
    half = s.length // 2
    left, right = s.hashes.runs(starts, starts + half), s.hashes.runs(starts + half, starts + s.length)
    return h, (mixed(left + mixed(right)) >> np.uint64(32)).astype(np.uint32)


def _position(h: np.ndarray, c: np.ndarray, sorted_h: np.ndarray, sorted_c: np.ndarray) -> np.ndarray:
    """Where each of the pairs, all known, is among the sorted ones."""
    at = np.searchsorted(sorted_h, h)
    while (other := sorted_c[at] != c).any():  # more than once only where 64 bits collide
        at = at + other
    return at


def _runs_by_owner(flags: np.ndarray, owner: np.ndarray, inner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, [[first, number], ...]) of its runs of flagged starts."""
    at = np.flatnonzero(flags)
    if not len(at):
        return
    cut = np.flatnonzero((np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])) + 1
    first, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
    runs = np.stack((inner[first], last - first + 1), axis=1).astype("<u2")
    edge = by_group(owner[first])
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        yield int(owner[first[x]]), runs[x:y]
