"""A word-end BPE vocabulary compiled, as far as the text needs it, into a deterministic transducer.

BPE has a prefix property: the encoding of s[:i] is the encoding of s[:i-|t|] followed by one token t,
and t is the only token that ends at i and that no merge joins to the last token before it.  So after a
prefix, all that the rest of the text can depend on is, for each position j from which some longer token
may still start, the trie node of s[j:i], the last token before j, and how many tokens the encoding of
s[:j] has less than that of s[:i].  These tuples, numbered as they are met, are the states.  A transition
on a byte emits the change in the number of tokens; the last byte of a pre-token is a symbol of its own,
which closes the count and leads back to the start.

Texts run in lockstep: the symbols are cut into equal chunks, and all chunks step together through the dense table.  A chunk has a state map,
entry -> (exit, emissions).  Maps are made for the start state first, and then for every state that the map of the chunk before leads to, until all maps
are closed: an entry is run until it meets the run from the start, after which both are the same.  Closed maps are small arrays, and a parallel prefix scan
composes them in log2(chunks) rounds, which gives each chunk's real entry.  Chunks whose entry is not the start take the emissions of that entry's run.

Memory is bounded: the table holds at most ``most_cells`` cells and is begun anew when full.
"""

from __future__ import annotations

import numpy as np

from . import wordbpe

NEVER = 1 << 30
START = 0


class Transducer:
    def __init__(self, path: str, most_cells: int = 30_000_000, chunk: int = 256):
        self.spec = spec = wordbpe.Spec(path)
        self.chunk, self.most_cells = chunk, most_cells
        self._merges(spec)
        self._trie(spec)
        self._compatible: dict[int, bool] = {}
        self._reset()

    # ---- compiling -------------------------------------------------------------------------------

    def _symbols(self, name: str) -> list[int]:
        end = name.endswith("</w>") and len(name) > 4
        out = [self._byte[c] for c in (name[:-4] if end else name)]
        if end:
            out[-1] += 256
        return out

    def _merges(self, spec) -> None:
        """Rank and result of each pair; for each token its last merge, and None if merging its own letters gives something else."""
        self._byte = {c: b for b, c in enumerate(wordbpe.byte_letters())}
        vocab, self.base = spec.vocab, [0] * 512
        for c, b in self._byte.items():
            self.base[b], self.base[b + 256] = vocab[c], vocab[c + "</w>"]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec.merges):
            self.pair.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.tree: dict[int, tuple[int, int, int] | None] = {}
        bases = set(self.base)
        for name, i in vocab.items():
            if i in bases:
                self.tree[i] = (-1, -1, -1)
                continue
            parts, last = [self.base[s] for s in self._symbols(name)], None
            while len(parts) > 1:
                best = min(((self.pair[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.pair), default=None)
                if best is None:
                    break
                rank, k = best
                last = (parts[k], parts[k + 1], rank)
                parts[k : k + 2] = [self.pair[parts[k], parts[k + 1]][1]]
            self.tree[i] = last if parts == [i] else None

    def _trie(self, spec) -> None:
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for name, i in spec.vocab.items():
            if self.tree[i] is None:
                continue
            node = 0
            for s in self._symbols(name):
                key = node * 512 + s
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token_at[node] = i

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens that stand at one edge while the token is merged, each with the ranks of its making and its end."""
        out, end = [], NEVER
        while True:
            t = self.tree[token]
            out.append((token, t[2], end))
            if t[2] < 0:
                return out
            token, end = t[side], t[2]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between the two tokens."""
        key = left << 20 | right
        got = self._compatible.get(key)
        if got is None:
            got = True
            pair, rights = self.pair, self._edge(right, 0)
            for a, made_a, end_a in self._edge(left, 1):
                for b, made_b, end_b in rights:
                    if max(made_a, made_b) < min(end_a, end_b) and (a, b) in pair:
                        rank = pair[a, b][0]
                        if rank < end_a and rank <= end_b:
                            got = False
                            break
                if not got:
                    break
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            self._compatible[key] = got
        return got

    def _reset(self) -> None:
        self.column = np.full(512, -1, dtype=np.int64)
        self.columns = 0
        self.width = 64
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.keys[0]: START}
        rows = 4096
        self.next = np.full((rows, self.width), -1, dtype=np.int32)  # state in the low 23 bits, emission + 128 above
        self.token = np.zeros((rows, self.width), dtype=np.uint16)

    def _grow(self, rows: int, width: int) -> None:
        for name, fill in (("next", -1), ("token", 0)):
            old = getattr(self, name)
            new = np.full((rows, width), fill, dtype=old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)
        self.width = width

    def _need(self, symbols: np.ndarray) -> None:
        new = np.unique(symbols)
        new = new[self.column[new] < 0]
        for s in new.tolist():
            if self.columns == self.width:
                self._grow(len(self.next), self.width * 2)
            self.column[s] = self.columns
            self.columns += 1

    def _make(self, state: int, symbol: int) -> None:
        after, found, count = [], -1, 0
        child, token_at, inner = self.child, self.token_at, self.inner
        for node, last, rel in self.keys[state]:
            node = child.get(node * 512 + symbol)
            if node is None:
                continue
            t = token_at[node]
            if t >= 0 and found < 0 and (last < 0 or self.compatible(last, t)):
                found, count = t, rel + 1
            if inner[node]:
                after.append((node, last, rel))
        if found < 0:
            raise ValueError("the vocabulary has no token for a byte")
        if symbol >= 256:
            to = START
        else:
            key = (*((n, x, r - count) for n, x, r in after), (0, found, 0))
            to = self.number.get(key)
            if to is None:
                to = self.number[key] = len(self.keys)
                self.keys.append(key)
                if to == len(self.next):
                    self._grow(2 * to, self.width)
        c = self.column[symbol]
        self.next[state, c] = to | (count + 128) << 23
        self.token[state, c] = found

    # ---- running ---------------------------------------------------------------------------------

    def _steps(self, states: np.ndarray, cols: np.ndarray, syms: np.ndarray) -> np.ndarray:
        cells = states * self.width
        cells += cols
        got = self.next.ravel().take(cells)
        if got.min() < 0:
            miss = np.flatnonzero(got < 0)
            for key in np.unique(states[miss].astype(np.int64) * 512 + syms[miss]).tolist():
                self._make(key >> 9, key & 511)
            got = self.next.ravel().take(states * self.width + cols)
        return got

    def _entries(self, came, went, leaves, cols, syms) -> np.ndarray:
        """The state in which each chunk is really entered, the first in the start, by composing the chunks' state maps.

        came, went: states and table cells of the runs from the start, which end in ``leaves``.
        """
        size, lanes = came.shape
        domain, exits, emitted = [{START: 0} for _ in range(lanes)], [[x] for x in leaves.tolist()], [[0] for _ in range(lanes)]
        lane = np.arange(lanes - 1)
        while lane.size:  # entries that no map has yet, of all chunks together; emissions are counted from those of the start's run
            fresh = []
            for k in lane.tolist():
                to = exits[k][-1]
                if to not in domain[k + 1]:
                    domain[k + 1][to] = len(domain[k + 1])
                    fresh.append((k + 1, to))
            if not fresh:
                break
            own, state = (np.array(x, dtype=np.int32) for x in zip(*fresh))
            out, more, at = leaves[own].copy(), np.zeros(len(own), dtype=np.int64), np.arange(len(own))
            for k in range(size):
                differ = came[k, own[at]] != state
                at, state = at[differ], state[differ]
                if not at.size:
                    break
                got = self._steps(state, cols[k, own[at]], syms[k, own[at]])
                more[at] += (got >> 23) - (went[k, own[at]] >> 23)
                state = got & 0x7FFFFF
            out[at] = state
            for k, x, n in zip(own.tolist(), out.tolist(), more.tolist()):
                exits[k].append(x)
                emitted[k].append(n)
            lane = own[own < lanes - 1]
        width = max(map(len, domain))
        maps, plus = np.zeros((lanes, width), dtype=np.int64), np.zeros((lanes, width), dtype=np.int64)
        for k in range(lanes - 1):
            maps[k, : len(exits[k])] = [domain[k + 1][x] for x in exits[k]]
            plus[k, : len(exits[k])] = emitted[k]
        composed, _ = compose(maps, plus)
        return np.array([START, *(list(domain[k + 1])[i] for k, i in enumerate(composed[:-1, 0].tolist()))], dtype=np.int32)

    def run(self, symbols: np.ndarray, want_tokens: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """For each symbol, the token that ends the encoding so far, and the tokens emitted (which may be negative)."""
        n, size = symbols.size, self.chunk
        if not n:
            return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int16)
        if self.next.size > self.most_cells:
            self._reset()
        self._need(symbols)
        lanes = -(-n // size)
        syms = np.empty(lanes * size, dtype=np.int16)
        syms[:n] = symbols
        syms[n:] = symbols[-1]
        syms = np.ascontiguousarray(syms.reshape(lanes, size).T)
        cols = self.column.astype(np.int32)[syms]
        came = np.empty((size, lanes), dtype=np.int32)  # state before each symbol
        went = np.empty((size, lanes), dtype=np.int32)  # what the table says there
        state = np.zeros(lanes, dtype=np.int32)
        for k in range(size):
            came[k] = state
            went[k] = got = self._steps(state, cols[k], syms[k])
            state = got & 0x7FFFFF
        leaves = state
        entry = self._entries(came, went, leaves, cols, syms)
        lane = np.flatnonzero(entry != START)
        state = entry[lane]
        for k in range(size):
            differ = came[k, lane] != state
            lane, state = lane[differ], state[differ]
            if not lane.size:
                break
            came[k, lane] = state
            went[k, lane] = got = self._steps(state, cols[k, lane], syms[k, lane])
            state = got & 0x7FFFFF
        emitted = ((went >> 23) - 128).astype(np.int16).T.reshape(-1)[:n]
        if not want_tokens:
            return None, emitted
        came *= self.width
        came += cols
        return self.token.ravel().take(came.T.reshape(-1)[:n]), emitted


def compose(maps: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix scan of state maps: row k of the result leads from row 0's entries through maps 0 to k, and has the emissions on the way.

    maps: for each chunk and number of an entry the number of the next chunk's entry.  Each round doubles how many maps a row has composed.
    """
    maps, emitted, reach = maps.copy(), emitted.copy(), 1
    while reach < len(maps):
        before = maps[:-reach]
        plus = emitted[:-reach] + np.take_along_axis(emitted[reach:], before, axis=1)
        maps[reach:] = np.take_along_axis(maps[reach:], before, axis=1)
        emitted[reach:] = plus
        reach *= 2
    return maps, emitted


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, how many stand before each text and in all): the bytes of the pre-tokens, 256 more for each one's last byte."""
    texts = [wordbpe.normalise(t) for t in texts]
    joined = "\n".join(texts)
    cp = wordbpe.code_points(joined)
    if not cp.size:
        return np.zeros(0, dtype=np.int16), np.zeros(len(texts) + 1, dtype=np.int64)
    kind, start = wordbpe.starts_of(cp)
    keep = kind != wordbpe.SPACE
    ends = keep.copy()  # the last letter of a pre-token: a start, white space or nothing follows
    ends[:-1] &= start[1:] | ~keep[1:]
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    symbols = raw.astype(np.int16)
    if raw.size == cp.size:
        symbols[ends] += 256
        at = np.cumsum(keep)
        symbols = symbols[keep]
    else:
        width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        symbols[(np.cumsum(width, dtype=np.int64) - 1)[ends]] += 256
        symbols = symbols[np.repeat(keep, width)]
        at = np.cumsum(width * keep, dtype=np.int64)
    last = np.cumsum([len(t) + 1 for t in texts]) - 2
    return symbols, np.concatenate(([0], np.where(last >= 0, at[np.minimum(np.maximum(last, 0), at.size - 1)], 0)))


def ids_of(symbols: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in order, and the symbol at which each ends: from the last token of every pre-token back to its first."""
    is_end = np.zeros(symbols.size, dtype=bool)
    at = np.flatnonzero(symbols >= 256)
    starts = np.concatenate(([0], at[:-1] + 1)) if at.size else at
    while at.size:
        is_end[at] = True
        at = at - lengths[tokens[at]]
        more = at >= starts
        at, starts = at[more], starts[more]
    ends = np.flatnonzero(is_end)
    return tokens[ends], ends
