"""unlike titles end before they are compared whole, and the pairs are those of all pairs."""

import random

import numpy as np
import pytest

from refsift.functions import similarity


def titles(seed, n):
    """Of one language, so counts of signs tell little; some changed a little."""
    r = random.Random(seed)
    parts = "the in of and tion er an ing re th es ble st en at to nd ou ha ed or ly".split()
    out = []
    for _ in range(n):
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.choice((24, 40, 60, 150)))]
        out.append(" ".join(words))
    for k in range(0, n, 5):
        signs = list(out[k])
        for _ in range(r.randint(0, len(signs) // 5)):
            at = r.randrange(len(signs))
            signs[at : at + 1] = r.choice(("", "x", "ee"))
        out.append("".join(signs))
    return out


@pytest.mark.parametrize("dated", [False, True])
def test_unlike_titles_end_early(dated, monkeypatch):
    seen = []
    beside, reaching = similarity._lcs_beside, similarity.lcs_reaching

    def counted(masks, first, padded, at, la, lb, need):
        seen.append(len(la))
        return beside(masks, first, padded, at, la, lb, need)

    def counted_one(a, b, least):
        seen.append(1)
        return reaching(a, b, least)

    monkeypatch.setattr(similarity, "_lcs_beside", counted)
    monkeypatch.setattr(similarity, "lcs_reaching", counted_one)
    monkeypatch.setattr(similarity, "_FEW", 1, raising=False)  # few pairs here
    one, two = titles(1, 100), titles(2, 80)
    one[7], two[3] = two[11], one[20][:-3]
    r = random.Random(3)
    for left, right in ((one, None), (one, two)):
        n = len(left) + len(right or [])
        years = np.array([r.choice((0, 2018, 2019, 2020, 2022)) for _ in range(n)]) if dated else np.zeros(n, np.int64)
        want, close = {}, 0
        for i, a in enumerate(left):
            for j, b in list(enumerate(left))[i + 1 :] if right is None else enumerate(right):
                x, y = int(years[i]), int(years[j if right is None else len(left) + j])
                gap = abs(x - y) if x and y else 0
                close += gap <= 1 and 200 * min(len(a), len(b)) >= 80 * (len(a) + len(b))
                if gap <= 1 and (score := similarity.indel_ratio(a, b)) >= (82 if gap else 80):
                    want[i, j] = score
        seen.clear()
        i, j, score = similarity.alike(left, right, 80, years, 82) if dated else similarity.alike(left, right, 80)
        assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), score.tolist(), strict=True)) == want and want
        assert sum(seen) < close / 3, (sum(seen), close)  # nine of ten before


def test_cut_projections_stay_bounds():
    """Whatever is cut of the longest, no LCS is told too short."""
    r = random.Random(6)
    for signs, longest in ((3, 20), (3, 90), (5, 300)):
        one, two = ([np.array([r.randrange(signs) for _ in range(r.choice((0, 1, longest // 2, longest, r.randint(0, longest))))], np.int64) for _ in range(40)] for _ in "ab")
        one[0] = np.zeros(4 * longest, np.int64)
        y, x = np.divmod(np.arange(1600), 40)
        got = similarity._lcs_or_more(one, two, x, y, signs)
        want = [similarity.lcs_length("".join(map(str, one[a])), "".join(map(str, two[b]))) for a, b in zip(x, y, strict=True)]
        assert (got >= want).all() and np.mean(got == want) > 0.5
