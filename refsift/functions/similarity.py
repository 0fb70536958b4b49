"""String and vector similarity.

`indel` is 100 * 2 * LCS(a, b) / (|a| + |b|): insertions and deletions only. It is computed by a bit-parallel LCS in an
Arrow UDF; `may_reach` is a cheaper JVM filter that never excludes a pair at or above a limit. `alike` compares all texts of
two blocks at once: counts of signs first, then the same LCS of what is left of the texts when all but a few signs go,
where nearly all pairs end, then of the texts, for thousands of pairs side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine-word-parallel step for each sign of b."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Two empty strings are alike."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def lcs_reaching(a: str, b: str, least: int) -> int:
    """The length of the longest common subsequence where it is least or more; else 0, as soon as that is certain."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for at in range(0, len(b), 64):
        for ch in b[at : at + 64]:
            hit = row & places.get(ch, 0)
            row = (row + hit | row - hit) & full
        left = max(len(b) - at - 64, 0)
        cut = max(len(a) - left, 0)
        if cut - (row & (1 << cut) - 1).bit_count() + min(left, len(a)) < least:
            return 0
    found = len(a) - row.bit_count()
    return found if found >= least else 0


#: Bits of a word of a row (one is left for the carry), pairs side by side, steps between two looks at what can still be
#: reached, signs that are counted by themselves.
_BITS, _BESIDE, _STEPS, _BAGS = 63, 4096, 16, 64
#: Groups of texts with like counts of signs; classes of signs have at least so many signs, and such a share of all, until
#: that share is reached; pairs that go through the classes together; fewer are not worth it.
_GROUPS, _CLASS, _SHARE, _CLASSED, _TOGETHER, _FEW = 4, 3, 0.08, 0.5, 16384, 30


def _masks(codes: np.ndarray, lengths: np.ndarray, signs: int, words: int, bits: int = _BITS) -> np.ndarray:
    """For each word, text and sign, the bits of the places where the text has the sign."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = ((place // bits) * len(lengths) + row) * signs + codes
    order = np.argsort(key, kind="stable")
    key, bit = key[order], (np.uint64(1) << (place % bits).astype(np.uint64))[order]
    out = np.zeros(words * len(lengths) * signs, np.uint64)
    if len(key):
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out[key[heads]] = np.bitwise_or.reduceat(bit, heads)
    return out.reshape(words, -1)


def _matched(rows: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Zero bits among the first upto of each pair's row."""
    found = np.zeros(len(upto), np.int64)
    for w in range(len(rows)):
        bits = np.clip(upto - w * _BITS, 0, _BITS).astype(np.uint64)
        found += np.bitwise_count(~rows[w] & ((np.uint64(1) << bits) - np.uint64(1)))
    return found


def _lcs_beside(masks: np.ndarray, first: np.ndarray, padded: np.ndarray, at: np.ndarray, la: np.ndarray, lb: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LCS lengths of pairs, all one step at a time: places of those that reach need, their lengths, and places of pairs
    left open when too few went on side by side. first: a pair's offset in the masks; at: its row in padded.

    A pair that reaches need leaves at most la - need signs of the one text and lb - need of the other, so places further
    than that from the diagonal aren't looked at: this drops no alignment that reaches need, and adds none. After j steps
    at most the row's value at la - (lb - j), and all signs that are left, can be reached."""
    live = np.arange(len(la))
    done, lengths = [], []
    ones = np.uint64((1 << _BITS) - 1)
    rows = np.full((len(masks), len(la)), ones)
    for s in range(0, int(lb.max(initial=0)), _STEPS):
        index = padded[at[live], s : s + _STEPS].T.astype(np.intp) + first[live]
        behind, ahead = int((lb - need)[live].max()), int((la - need)[live].max())
        hit, total, carry = (np.empty(len(live), np.uint64) for _ in range(3))
        for k in range(len(index)):
            low, high = max(0, (s + k - behind) // _BITS), min(len(masks) - 1, (s + k + ahead) // _BITS)
            for w in range(low, high + 1):
                row = rows[w]
                np.take(masks[w], index[k], out=hit, mode="clip")
                np.bitwise_and(hit, row, out=hit)
                np.add(row, hit, out=total)
                if w > low:
                    np.add(total, carry, out=total)
                if w < high:
                    np.right_shift(total, np.uint64(_BITS), out=carry)
                np.bitwise_xor(row, hit, out=row)
                np.bitwise_or(row, total, out=row)
                np.bitwise_and(row, ones, out=row)
        a, left = la[live], np.maximum(lb[live] - s - _STEPS, 0)
        upto = np.maximum(a - left, 0)
        can = _matched(rows, upto) + np.minimum(a - upto, left)
        good, ended = can >= need[live], left == 0
        done.append(live[good & ended])
        lengths.append(can[good & ended])
        stay = good & ~ended
        if 4 * np.count_nonzero(stay) < 3 * len(live):
            live, rows = live[stay], np.ascontiguousarray(rows[:, stay])
        elif ended.any():  # what has ended is not told twice
            live, rows = live[stay], np.ascontiguousarray(rows[:, stay])
        if len(live) < 3 * len(masks) + 8:
            break
    return np.concatenate([*done, live[:0]]), np.concatenate([*lengths, np.zeros(0, np.int64)]), live


def _groups(bags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text a group of texts whose signs are alike in their shares. What is found does not depend on them."""
    share = bags.astype(np.float32) / lengths[:, None].astype(np.float32)
    centres = share[:1]
    far = np.full(len(share), np.inf, np.float32)
    while len(centres) < min(_GROUPS, len(share)):
        far = np.minimum(far, ((share - centres[-1]) ** 2).sum(1))
        centres = np.concatenate([centres, share[[far.argmax()]]])
    for _ in range(4):
        group = ((centres**2).sum(1)[None, :] - 2 * share @ centres.T).argmin(1)
        own = [share[group == g] for g in range(len(centres))]
        centres = np.stack([o.mean(0) if len(o) else c for o, c in zip(own, centres, strict=True)])
    return group


def _classes(often: np.ndarray, length: float) -> list[np.ndarray]:
    """Signs of like frequency in classes, the rarest first; smaller ones where texts are long, so that a word holds them."""
    out, first, total = [], 0, often.sum()
    share = min(_SHARE, max(_SHARE / 2, 56 / length))
    order = np.argsort(often, kind="stable")[np.count_nonzero(often == 0) :]
    for at in range(1, len(order) + 1):
        mass = often[order[first:at]].sum()
        if at - first >= _CLASS and mass >= share * total:
            out.append(order[first:at])
            first = at
            if often[order[:at]].sum() > _CLASSED * total:
                break
    return out


def _only(held: list[np.ndarray], signs: np.ndarray) -> list[np.ndarray]:
    """What is left of texts when all but these signs go, as numbers of the signs."""
    number = np.full(_BAGS, -1)
    number[signs] = np.arange(len(signs))
    sizes = np.array([len(t) for t in held], np.int64)
    told = number[np.concatenate(held)]
    kept = np.add.reduceat(told >= 0, np.cumsum(sizes) - sizes)
    return np.split(told[told >= 0], np.cumsum(kept)[:-1])


def _lcs_or_more(one: list[np.ndarray], two: list[np.ndarray], x: np.ndarray, y: np.ndarray, signs: int) -> np.ndarray:
    """The LCS, or more, of one[x] and two[y] for each pair, over numbers under signs; pairs of like y lie together.

    Words are as wide as most texts of one are long; the longest of both sides are cut, and what is cut counts."""
    la, lb = (np.array([len(t) for t in side], np.int64) for side in (one, two))
    usual, most = (max(1, int(np.quantile(n, 0.85))) for n in (la, lb))
    if usual <= 64:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if usual <= np.iinfo(k).bits)
        words, bits, full = 1, np.iinfo(kind).bits, kind(np.iinfo(kind).max)
    else:
        kind, words, bits, full = np.uint64, -(-usual // _BITS), _BITS, np.uint64((1 << _BITS) - 1)
    over_a, over_b = np.maximum(la - words * bits, 0), np.maximum(lb - most, 0)
    masks = _masks(np.concatenate([t[: words * bits] for t in one]), la - over_a, signs + 1, words, bits).astype(kind)
    steps = np.full((most, len(two)), signs, np.intp)  # the last number stands for no sign
    for k, t in enumerate(two):
        steps[: len(t), k] = t[:most]
    found = over_a[x] + over_b[y]
    for s in range(0, len(x), _TOGETHER):
        part = y[s : s + _TOGETHER]
        first = x[s : s + _TOGETHER] * (signs + 1)
        rows = np.full((words, len(part)), full)
        index = np.empty(len(part), np.intp)
        hit, total, carry = (np.empty(len(part), kind) for _ in range(3))
        for step in steps[: int(lb[part].max())]:
            step.take(part, out=index, mode="clip")
            np.add(index, first, out=index)
            for w in range(words):
                row = rows[w]
                masks[w].take(index, out=hit, mode="clip")
                np.bitwise_and(hit, row, out=hit)
                np.add(row, hit, out=total)
                if words > 1:
                    if w:
                        np.add(total, carry, out=total)
                    np.right_shift(total, kind(_BITS), out=carry)
                np.bitwise_xor(row, hit, out=row)
                np.bitwise_or(row, total, out=row)
                if words > 1:
                    np.bitwise_and(row, full, out=row)
        for row in rows:
            found[s : s + _TOGETHER] += np.bitwise_count(row ^ full)
    return found


def _open_pairs(one: list[np.ndarray], two: list[np.ndarray], met: np.ndarray, spare: np.ndarray, shared: list[np.ndarray], classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in two and in one of the pairs of met (a row for each text of two) that may have what they need.

    Of the signs of a class two texts have no more in common than the LCS of what is left when all other signs go: short
    texts of like frequent signs, whose LCS is far below the counts that they share. spare is what the counts of all
    signs share beyond the need, shared what those of each class do; a pair goes once it has nothing to spare."""
    y, x = np.nonzero(met)
    left = spare[y, x]
    for c, signs in enumerate(classes):
        if len(x) < _FEW:
            break
        counted = shared[c][y, x]
        left = left - counted + np.minimum(counted, _lcs_or_more(_only(one, signs), _only(two, signs), x, y, len(signs)))
        y, x, left = (v[left >= 0] for v in (y, x, left))
    return y, x


def alike(left: list[str], right: list[str] | None, limit: int, years: np.ndarray | None = None, apart: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, score of all pairs of left[i] and right[j] (without right: of left[i] and left[j], i < j) whose indel ratio
    is limit or more. No text may be empty. Texts of very different lengths are best kept in different blocks.

    Where there are years (of left, then of right; 0 is unknown), pairs of adjacent ones need `apart`, and those of years
    further apart are left out."""
    texts = left + (right or [])
    n = len(left)
    lengths = np.array([len(t) for t in texts], np.int64)
    _, inverse, often = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    codes = rank[inverse]
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    small = np.uint16 if lengths.max(initial=0) < 1 << 16 else np.int32
    bags = np.bincount(owner * _BAGS + np.minimum(codes, _BAGS - 1), minlength=len(texts) * _BAGS).reshape(-1, _BAGS).astype(small)
    ones, two = np.arange(n), np.arange(n) if right is None else np.arange(n, len(texts))
    group = _groups(bags, lengths) if len(texts) else ones

    def limits(one: np.ndarray, two: np.ndarray) -> np.ndarray | int:
        """What pairs need; over 100 if they are left out."""
        if years is None:
            return limit
        gap = np.where((years[one] == 0) | (years[two] == 0), 0, np.abs(years[one] - years[two]))
        return np.where(gap == 0, limit, np.where(gap == 1, apart, 101))

    by_length = np.argsort(lengths, kind="stable")
    parts = [[side[group[side] == g] for side in (by_length[by_length < n], by_length[by_length >= two[0]] if len(two) else two)] for g in range(_GROUPS)]
    counted = np.minimum(codes, _BAGS - 1)  # signs that are not counted by themselves are taken for one: more may be common
    i, j = [], []
    for g, h in ((g, h) for g in range(_GROUPS) for h in range(g if right is None else 0, _GROUPS)):
        a, b = parts[g][0], parts[h][1]
        if not len(a) or not len(b):
            continue
        often_here = bags[a].sum(0, dtype=np.int64) + bags[b].sum(0, dtype=np.int64)
        classes = _classes(often_here, float(lengths[np.concatenate([a, b])].mean()))
        others = np.setdiff1d(np.flatnonzero(often_here), np.concatenate([*classes, ones[:0]]))
        one = [counted[starts[t] : starts[t] + lengths[t]] for t in a]
        counts = np.ascontiguousarray(bags[a].T)
        strip = max(1, (1 << 20) // len(a))
        for s in range(0, len(b), strip):
            part = b[s : s + strip]
            both = lengths[part][:, None] + lengths[a][None, :]
            need = -(-limits(part[:, None], a[None, :]) * both // 200)
            met = np.minimum(lengths[part][:, None], lengths[a][None, :]) >= need
            if right is None and g == h:
                met &= np.arange(len(a))[None, :] < np.arange(s, s + len(part))[:, None]
            if not met.any():
                continue
            least = np.empty(both.shape, small)
            shared = []
            for signs in (*classes, others):
                shared.append(np.zeros(both.shape, small))
                for k in signs:
                    shared[-1] += np.minimum(bags[part, k][:, None], counts[k][None, :], out=least)
            spare = sum(shared[1:], shared[0].astype(np.int32)) - need.astype(np.int32)
            met &= spare >= 0
            y, x = _open_pairs(one, [counted[starts[t] : starts[t] + lengths[t]] for t in part], met, spare, shared, classes)
            i.append(a[x])
            j.append(part[y])
    i, j = np.concatenate([*i, ones[:0]]), np.concatenate([*j, ones[:0]])
    if right is None:
        i, j = np.minimum(i, j), np.maximum(i, j)
    if not len(i):
        return i, j, np.zeros(0)
    need = -(-limits(i, j) * (lengths[i] + lengths[j]) // 200)
    order = np.argsort(lengths[i], kind="stable")
    i, j, need = i[order], j[order], need[order]
    signs = len(often) + 1  # the last stands for no sign
    low = int(two[0])
    padded = np.full((len(two), int(lengths[two].max())), signs - 1, np.int32)
    mine = owner >= low
    padded[owner[mine] - low, (np.arange(len(owner)) - starts[owner])[mine]] = codes[mine]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    s = 0
    while s < len(i):
        e = min(s + _BESIDE, len(i))
        used, row_of = np.unique(i[s:e], return_inverse=True)
        words = -(-int(lengths[used].max()) // _BITS)
        most = max(1, (1 << 22) // (signs * words))  # texts whose masks are held at once
        if len(used) > most:
            ordered = np.argsort(i[s:e], kind="stable")
            i[s:e], j[s:e], need[s:e] = i[s:e][ordered], j[s:e][ordered], need[s:e][ordered]
            e = s + int(np.searchsorted(i[s:e], used[most]))
            used, row_of = np.unique(i[s:e], return_inverse=True)
        x, y, least = i[s:e], j[s:e], need[s:e]
        opened = np.arange(len(x))
        if len(x) >= 3 * words + 8:
            held = np.concatenate([codes[starts[t] : starts[t] + lengths[t]] for t in used])
            masks = _masks(held, lengths[used], signs, words)
            good, found, opened = _lcs_beside(masks, row_of * signs, padded, y - low, lengths[x], lengths[y], least)
            kept.append((x[good], y[good], found))
        told = np.array([lcs_reaching(texts[x[k]], texts[y[k]], int(least[k])) for k in opened], np.int64)
        kept.append((x[opened][told > 0], y[opened][told > 0], told[told > 0]))
        s = e
    a, b, found = (np.concatenate([k[c] for k in kept] or [ones[:0]]) for c in range(3))
    return a, b if right is None else b - n, 200.0 * found / (lengths[a] + lengths[b])


def partial_indel_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of at most its length, which may hang
    over either end; 0 where that is under `least`. An empty string is like another empty string only.

    Where a stretch has a common subsequence of l signs, the one that begins j places on has l + j at most, since it
    lacks j signs of the first and has j others. So the search goes on where the best so far, or `least`, can be beaten
    first, and stretches far from both cost nothing."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return (100.0 if not long_ else 0.0) if least <= 100 else 0.0
    n, m = len(short), len(long_)
    places: dict[str, int] = {}
    for i, ch in enumerate(short):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << n) - 1
    best, found = least, 0.0

    def common(part: str) -> int:
        row = full
        for ch in part:
            hit = row & places.get(ch, 0)
            row = (row + hit | row - hit) & full
        return n - row.bit_count()

    # stretches that hang over: of w signs, and so with w in common at most
    ends = [(2 * w * 100.0 / (n + w), part) for w in range(min(n, m + 1) - 1, 0, -1) for part in ((long_[:w], long_[m - w :]) if w < m else (long_,))]
    at = 0
    while at + n <= m and found < 100.0:
        length = common(long_[at : at + n])
        ratio = 200.0 * length / (2 * n)
        if ratio > best or ratio == best > found:
            best = found = ratio
        needed = math.floor(best * n / 100.0) + 1 if found else math.ceil(best * n / 100.0 - 1e-9)
        at += max(1, needed - length)
    for bound, part in ends:
        if found == 100.0 or bound < best:
            break
        ratio = 200.0 * common(part) / (n + len(part))
        if ratio > best or ratio == best > found:
            best = found = ratio
    return found


def partial_indel_reaches(a: str, b: str, least: float) -> bool:
    """Whether `partial_indel_ratio` is least or more (least over 0).

    A stretch of w signs that reaches it has l >= least * (n + w) / 200 signs in common with the n of the shorter text, so
    at most n + w - 2 l signs of both are left over, fewest for the longest stretch: d in all, for w = n. Each of them
    spoils at most one of d + 1 pieces of the shorter text, so one piece at least stands whole in the stretch, at most d
    places from where it stands in the shorter text. Only such places are looked at, and each only once."""
    short, long_ = sorted((a, b), key=len)
    n, m = len(short), len(long_)
    if not short or least <= 0:
        return partial_indel_ratio(a, b, least) >= least
    d = int((200.0 - 2 * least) * n / 100.0 + 1e-9)
    if d + 1 > n // 2:  # pieces of a sign or two stand everywhere
        return partial_indel_ratio(a, b, least) >= least
    places: dict[str, int] = {}
    for i, ch in enumerate(short):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << n) - 1
    seen = bytearray(m + 2 * n)

    def common(part: str) -> int:
        row = full
        for ch in part:
            hit = row & places.get(ch, 0)
            row = (row + hit | row - hit) & full
        return n - row.bit_count()

    for k in range(d + 1):
        start, end = k * n // (d + 1), (k + 1) * n // (d + 1)
        piece = short[start:end]
        hit = long_.find(piece)
        while hit >= 0:
            at, last = max(hit - start - d, 1 - n), min(hit - start + d, m - 1)  # where it may begin; under 0 it hangs over
            while at <= last and (at := seen.find(0, at + n, last + n + 1) - n) > -n:
                seen[at + n] = 1
                part = long_[max(at, 0) : at + n]
                length = common(part)
                if 200.0 * length / (n + len(part)) >= least:
                    return True
                if len(part) < n:
                    at += 1
                    continue
                step = max(1, math.ceil(least * n / 100.0 - 1e-9) - length)
                for x in range(at + 1, min(at + step, m - n + 1)):
                    seen[x + n] = 1
                at += step if at + step + n <= m else max(1, min(step, m - n + 1 - at))
            hit = long_.find(piece, hit + 1)
    return False


def token_set_ratio_of(a: str, b: str) -> float:
    """The best of three ratios between the common words, and the common words with either string's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, own, other = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not own or not other):
        return 100.0
    left, right = f"{common} {own}".strip(), f"{common} {other}".strip()
    found = [indel_ratio(left, right)]
    if common:
        found += [indel_ratio(common, left), indel_ratio(common, right)]
    return max(found)


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def indel(a: Column, b: Column) -> Column:
    return _indel(a, b)


def partial_indel(a: Column, b: Column, least: float = 0.0) -> Column:
    """The best ratio with a stretch of the longer text, 0 under `least`; the higher `least` is, the less is searched."""

    @F.pandas_udf(DoubleType())
    def partial(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([partial_indel_ratio(p or "", q or "", least) for p, q in zip(x, y, strict=True)], dtype="float64")

    return partial(a, b)


def partial_reaches(a: Column, b: Column, least: float) -> Column:
    """Whether the best ratio with a stretch of the longer text is least or more."""

    @F.pandas_udf(BooleanType())
    def reaches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([partial_indel_reaches(p or "", q or "", least) for p, q in zip(x, y, strict=True)], dtype="bool")

    return reaches(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _token_set(a, b)


def may_reach(a: Column, b: Column, limit: int) -> Column:
    """Whether the indel ratio can be limit or more: Levenshtein's distance is at most the indel distance."""
    total = F.length(a) + F.length(b)
    lengths = F.lit(200) * F.least(F.length(a), F.length(b)) >= F.lit(limit) * total
    return lengths & (F.levenshtein(a, b) * 100 <= total * (100 - limit))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def norm(c: Column) -> Column:
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))

    return F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))


def best_title(wanted: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """wanted: key, title, year; found: key, rank, title, year, value. The first candidate alike to `least` whose year is
    adjacent at most (where both are known)."""
    c = found.select("key", "rank", F.col("title").alias("_t"), F.col("year").alias("_y"), "value")
    met = wanted.join(c, "key").withColumn("_score", indel(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("_t", F.lit("")))))
    near = F.coalesce(F.abs(F.col("year") - F.col("_y")) <= 1, F.lit(True))
    return met.where((F.col("_score") >= least) & near).groupBy("key").agg(F.min_by("value", "rank").alias("value"))
