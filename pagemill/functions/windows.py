"""The best windows of many texts at once: longest common subsequences as bit vectors, a lane for each stretch of text.

A stretch of twice the phrase's length bounds all windows in it, so most texts are passed over in two steps a
character; stretches that may hold a better window are halved until they are single windows.
"""

from __future__ import annotations

import numpy as np

#: Bits of a phrase in a word of its vector; the last bit takes the carry.
BITS = 63
FULL = np.uint64((1 << BITS) - 1)
#: Words of stretches looked at together, characters dealt out at once, entries of the tables of a group of phrases.
LANES, BLOCK, ENTRIES = 16384, 64, 1 << 20
#: Assumed microseconds: a call of NumPy, a word of a lane there; a step of ``common_subsequence`` and a word there.
CALL, WORD, STEP, STEP_WORD = 0.6, 0.006, 0.25, 0.008


def common_subsequence(a: str, masks: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and a pattern of n characters given as bit masks."""
    full = (1 << n) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(phrase: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(phrase):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Group:
    """Texts and phrases of about one length: codes of the texts, and for each phrase and code its places as words of bits."""

    def __init__(self, asked: list[tuple[str, str]]):
        self.asked = asked
        self.n = np.array([len(p) for _, p in asked])
        self.words = -(-int(self.n.max()) // BITS)
        texts = {id(t): t for t, _ in asked}
        sizes = np.array([len(t) for t in texts.values()])
        at = dict(zip(texts, (np.cumsum(sizes) - sizes).tolist(), strict=True))
        self.offset = np.array([at[id(t)] for t, _ in asked])
        phrases = _points("".join(p for _, p in asked))
        chars = np.unique(phrases)
        code = np.zeros(0x110000, np.uint16 if len(chars) < 1 << 16 else np.uint32)
        code[chars] = np.arange(1, len(chars) + 1)
        self.codes = np.concatenate([*(code[_points(t)] for t in texts.values()), np.zeros(BLOCK, code.dtype)])
        self.step = len(chars) + 1
        self.tables = np.zeros((self.words, len(asked) * self.step), np.uint64)
        owner = np.repeat(np.arange(len(asked)), self.n)
        place = np.arange(len(phrases)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        np.bitwise_or.at(self.tables, (place // BITS, owner * self.step + code[phrases]), np.uint64(1) << (place % BITS).astype(np.uint64))
        self.masks: dict[int, dict[str, int]] = {}

    def common(self, q: np.ndarray, start: np.ndarray, count: np.ndarray, apart: int) -> np.ndarray:
        """Longest common subsequences of phrases ``q`` and stretches of their texts that hold ``count`` windows.

        Only characters that a window and its phrase have at most ``apart`` places from one another need to meet.
        """
        out, length = np.empty(len(q), np.int64), self.n[q] + count - 1
        order = np.argsort(length, kind="stable")
        lanes = max(64, LANES // self.words)
        for k in range(0, len(order), lanes):
            some = order[k : k + lanes]
            many = len(some)
            if many * (STEP + STEP_WORD * self.words) < 9 * CALL + many * self.words * WORD:
                out[some] = [self._one(*x) for x in zip(q[some].tolist(), start[some].tolist(), length[some].tolist(), strict=True)]
            else:
                out[some] = self._many(q[some], start[some], length[some], int(count[some].max()) - 1 + apart, apart)
        return out

    def _one(self, q: int, start: int, length: int) -> int:
        text, phrase = self.asked[q]
        if q not in self.masks:
            self.masks[q] = masks_of(phrase)
        return common_subsequence(text[start : start + length], self.masks[q], len(phrase))

    def _many(self, q: np.ndarray, start: np.ndarray, length: np.ndarray, behind: int, ahead: int) -> np.ndarray:
        """``length`` ascends, so that the lanes that have ended are the first ones.

        In a turn each word of the vectors takes the character after that of the next word, whose carry it hands on
        in the turn after; the last word is the first row.
        """
        words, out = self.words, np.empty(len(q), np.int64)
        begin, base = self.offset[q] + start, q * self.step
        stretches = np.lib.stride_tricks.sliding_window_view(self.codes, BLOCK)
        table, row = self.tables.reshape(-1), np.arange(words - 1, -1, -1)[:, None] * self.tables.shape[1]
        v, carry = np.full((words, len(q)), FULL), np.zeros((words + 1, len(q)), np.uint64)
        index = np.repeat(base[None], words - 1, axis=0)  # a place of no character
        done = 0
        for t0 in range(0, int(length[-1]) + words - 1, BLOCK):
            ended = int(np.searchsorted(length, t0 - words + 1, "right"))
            if ended > done:
                out[done:ended] = self._zeros(v[:, : ended - done])
                v, carry, index = (x[:, ended - done :].copy() for x in (v, carry, index))
                done = ended
            at = begin[done:] + t0
            new = stretches[np.minimum(at, len(stretches) - 1)].T.astype(np.intp, order="C")
            for x, over in enumerate(np.searchsorted(length, np.arange(t0, t0 + BLOCK), "right").tolist()):
                if over > done:  # behind a stretch's end there is no character either
                    new[x, : over - done] = 0
            new += base[done:]
            index = np.concatenate([index[max(0, len(index) - words + 1) :], new]) if words > 1 else new
            m, s, place = np.empty(v.shape, np.uint64), np.empty(v.shape, np.uint64), np.empty(v.shape, np.intp)
            for x in range(min(BLOCK, int(length[-1]) + words - 1 - t0)):
                t = t0 + x
                if words == 1:
                    table.take(index[x : x + 1], out=m, mode="clip")
                    np.bitwise_and(m, v, out=m)
                    np.add(v, m, out=s)
                    np.bitwise_xor(v, m, out=v)
                    np.bitwise_or(v, s, out=v)
                    continue
                # words whose places all lie too far ahead or behind have no more to meet
                low, high = max(0, words - 1 - (t + ahead) // (BITS + 1)), min(words, words + (BITS - 1 + behind - t) // (BITS + 1))
                if low >= high:
                    carry.fill(0)
                    continue
                vv, mm, ss, pp = v[low:high], m[low:high], s[low:high], place[low:high]
                np.add(index[x + low : x + high], row[low:high], out=pp)
                table.take(pp, out=mm, mode="clip")
                np.bitwise_and(mm, vv, out=mm)
                np.add(vv, mm, out=ss)
                np.add(ss, carry[low + 1 : high + 1], out=ss)
                np.right_shift(ss, BITS, out=carry[low:high])
                carry[high] = 0  # of a word that has no more to meet, taken over just now
                np.bitwise_xor(vv, mm, out=vv)
                np.bitwise_or(vv, ss, out=vv)
                np.bitwise_and(vv, FULL, out=vv)
        out[done:] = self._zeros(v)
        return out

    def _zeros(self, v: np.ndarray) -> np.ndarray:
        return len(v) * BITS - np.bitwise_count(v & FULL).sum(axis=0, dtype=np.int64)

    def best(self, threshold: float) -> np.ndarray:
        """For each phrase the start of its first best window above the threshold, or -1."""
        n = self.n
        windows = np.array([len(t) for t, _ in self.asked]) - n + 1
        best, place = threshold * n, np.full(len(n), -1)
        apart = int((n - best).max()) + 1
        parts = -(-windows // n)
        q = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(q)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = windows[q] * k // parts[q], windows[q] * (k + 1) // parts[q]
        while len(q):
            count = end - start
            most = self.common(q, start, count, apart)
            last = place[q]
            # one as good as the best window, or a stretch that may hold one, counts where it is earlier
            fit = (most > best[q]) | ((most == best[q]) & (last >= 0) & (start < last))
            alone = fit & (count == 1)
            if alone.any():  # of each phrase the best, of these the first
                order = np.lexsort((start[alone], -most[alone], q[alone]))
                mine, first = np.unique(q[alone][order], return_index=True)
                at, score = start[alone][order][first], most[alone][order][first]
                best[mine], place[mine] = score, at
            last = place[q]
            live = (count > 1) & ((most > best[q]) | ((most == best[q]) & (last >= 0) & (start < last)))
            q, start, end, most = q[live], start[live], end[live], most[live]
            if not len(q):
                break
            order = np.lexsort((start, -most, q))
            first = order[np.unique(q[order], return_index=True)[1]]
            middle = (start + end) // 2
            probe = middle[first]  # a window of the most promising stretch, so that others fall away
            q, start, end = np.concatenate([q, q, q[first]]), np.concatenate([start, middle, probe]), np.concatenate([middle, end, probe + 1])
        return place


def best_windows(asked: list[tuple[str, str]], threshold: float) -> list[int]:
    """For each (text, phrase), both lower-case, the start of its first best window above the threshold, or -1.

    A window is as long as the phrase, which isn't empty and no longer than the text; its similarity is the share
    of a longest common subsequence.
    """
    out = [-1] * len(asked)
    order = sorted(range(len(asked)), key=lambda k: len(asked[k][1]))
    k = 0
    while k < len(order):
        some: list[int] = []
        words = -(-len(asked[order[k]][1]) // BITS)
        chars: set[str] = set()
        while k < len(order):
            phrase = asked[order[k]][1]
            more = -(-len(phrase) // BITS)
            wider = chars.union(phrase)
            if some and (more > words * 5 // 4 or (len(some) + 1) * (len(wider) + 1) * more > ENTRIES):
                break
            some.append(order[k])
            chars = wider
            k += 1
        for x, at in zip(some, _Group([asked[x] for x in some]).best(threshold).tolist(), strict=True):
            out[x] = at
    return out
