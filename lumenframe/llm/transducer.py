"""A byte-level BPE vocabulary compiled to a deterministic transducer over bytes.

Every step reads one byte and emits the change in the number of tokens. A state stands for all
that decides later steps: for each place inside the current word from which a vocabulary entry
may still be growing, the node of the vocabulary trie, the last token before that place, and
how many tokens it lies behind. States and transitions are compiled when first met. Most states go
on by two or three bytes only, so a state's row is kept in blocks of 32 bytes, and only blocks with a
transition take room; a task keeps its states as packed numbers.

Two facts make this finite. The tokens of a prefix of a word (up to one of its token ends) are
the tokens of that prefix on its own, and a row of tokens is the right one exactly when each
neighbouring pair is. So the last token of a prefix follows from the last token at its start.

Texts are cut into chunks of equal size that advance together. What a chunk does to a state is
a map; a chunk in which a word starts has a constant map from there on, so only the bytes before
its first word start wait for the state handed in. No map is built: those bytes are run again once
the chunk before is known, in one round, and one more for each further chunk that a single word spans.
"""

from __future__ import annotations

import json
import struct

import numpy as np

CHUNK = 512             # bytes that one lane reads
BATCH_CHARS = 1 << 19   # characters that are processed together
MAX_STATES = 120_000    # the table is begun anew above this; results do not depend on it
LETTER, NUMBER, MARK, SPACE_LIKE, SPACE, EDGE, UNSEEN = 0, 1, 2, 3, 4, 9, 255
PAD = 255               # a byte that UTF-8 never uses
ROOT, UNKNOWN = 0, 1    # states: at a word start; before the first word start of a chunk
BIAS = 128              # packed transitions hold state * 256 + delta + BIAS
BLOCK = 32              # transitions of a state that take room together
ROW = 256 // BLOCK      # blocks of a state


def pack(numbers: list[int]) -> bytes:
    return struct.pack(f"={len(numbers)}i", *numbers)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stays, the rest follows U+0100."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts or lists the ids of texts as the tokenizer of a byte-level BPE ``.json`` file does."""

    def __init__(self, file: bytes):
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE with the usual word pattern, no prefix space and no normaliser can be compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Asked for the class of characters it has not seen: its tables may be of another Unicode version than ours.
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        symbols = byte_symbols()
        bytes_of = {i: bytes(symbols[c] for c in s) for s, i in model["vocab"].items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            if whole in self.parts:
                raise ValueError("two merges make the same token")
            self.merge_rank[a, b] = rank
            self.parts[whole] = (a, b, rank)
        # Entries in the order of their bytes: those below a trie node stand side by side.
        self.order = sorted(bytes_of, key=bytes_of.__getitem__)
        self.trie: dict[int, int] = {}      # child by node * 256 + byte
        self.ends: dict[int, int] = {}
        first, stop = [0], [len(self.order)]
        for i, token in enumerate(self.order):
            node = 0
            for b in bytes_of[token]:
                child = self.trie.get(node * 256 + b)
                if child is None:
                    child = self.trie[node * 256 + b] = len(first)
                    first.append(i)
                    stop.append(i)
                node = child
                stop[node] = i + 1
            self.ends[node] = token
        self.first, self.stop = np.array(first, np.int32), np.array(stop, np.int32)
        self.inner = bytes(b - a > (n in self.ends) for n, (a, b) in enumerate(zip(first, stop)))   # nodes with entries below
        self.partners: dict[int, list[tuple[int, int]]] = {}
        for (a, b), rank in self.merge_rank.items():
            self.partners.setdefault(a, []).append((b, rank))
        self.spines: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        self.heads: dict[int, set[int]] = {}
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        self.length = np.zeros(max(bytes_of) + 1, np.int64)
        self.length[list(bytes_of)] = [len(b) for b in bytes_of.values()]
        self.restart()

    # -- compilation

    def restart(self) -> None:
        self.table = np.zeros((1 << 12, ROW), np.int32)    # where each block of a state's row begins in moves
        self.moves = np.full(1 << 16, -1, np.int32)                 # the first block is that of rows without transitions
        self.filled = BLOCK
        self.last = np.full(1 << 12, -1, np.int32)
        self.keys: list[bytes] = []
        self.number: dict[bytes, int] = {}
        # Known answers, by first number << 32 plus second.
        self.alike: dict[int, int] = {}
        self.first_of: dict[bytes, int] = {}
        self.fits: dict[int, bool] = {}
        self.state_of(pack([0, -1, 0]), -1)
        self.state_of(b"unknown", -1)
        self.put(UNKNOWN, 0, -1)
        self.table[UNKNOWN] = at = self.table[UNKNOWN, 0]
        self.moves[at:at + BLOCK] = UNKNOWN * 256 + BIAS

    def state_of(self, key: bytes, last: int) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys)
            self.keys.append(key)
            if n >= len(self.table):
                more = len(self.table) // 4
                self.table = np.concatenate([self.table, np.zeros_like(self.table[:more])])
                self.last = np.concatenate([self.last, np.full_like(self.last[:more], -1)])
            self.last[n] = last
        return n

    def put(self, state: int, byte: int, move: int) -> None:
        at = int(self.table[state, byte // BLOCK])
        if not at:
            at = self.table[state, byte // BLOCK] = self.filled
            self.filled += BLOCK
            if self.filled > len(self.moves):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves[:len(self.moves) // 4], -1)])
        self.moves[at + byte % BLOCK] = move

    def spine(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """(part, rank that made it, rank that used it up) down one side of a token's merge tree."""
        out = self.spines.get((token, right))
        if out is None:
            out, part, used = [], token, len(self.merge_rank)
            while part >= 0:
                a, b, rank = self.parts.get(part, (-1, -1, -1))
                out.append((part, rank, used))
                part, used = (b if right else a), rank
            self.spines[token, right] = out
        return out

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border while the two tokens are built, leftmost first among equal ranks."""
        known = self.fits.get((a << 32) + b)
        if known is None:
            known = True
            for x, made_x, used_x in self.spine(a, True):
                for y, made_y, used_y in self.spine(b, False):
                    rank = self.merge_rank.get((x, y))
                    if rank is not None and max(made_x, made_y) < rank < used_x and rank <= used_y:
                        known = False
            self.fits[(a << 32) + b] = known
        return known

    def compile(self, state: int, byte: int) -> None:
        if byte == PAD:
            return self.put(state, PAD, state * 256 + BIAS)
        grown, chosen, delta = [], -1, 0
        for node, last, behind in struct.iter_unpack("=3i", self.keys[state]):
            child = self.trie.get(node * 256 + byte)
            if child is None:
                continue
            token = self.ends.get(child, -1)
            if chosen < 0 <= token and self.is_whole(token) and (last < 0 or self.pair_fits(last, token)):
                chosen, delta = token, behind + 1
            if self.inner[child]:
                alike = self.alike.get((child << 32) + last)
                if alike is None:
                    alike = self.same_last(child, last)
                grown.append((child, alike, behind))
        if chosen < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = pack([x for c, p, n in grown for x in (c, p, n - delta)] + [0, chosen, 0])
        self.put(state, byte, self.state_of(key, chosen) * 256 + delta + BIAS)

    def heads_below(self, node: int) -> set[int]:
        """The parts at the left side of the entries below a trie node, collected when first asked for."""
        heads = self.heads.get(node)
        if heads is None:
            heads = set()
            for token in self.order[self.first[node] + (node in self.ends):self.stop[node]]:
                while token >= 0 and token not in heads:
                    heads.add(token)
                    token = self.parts.get(token, (-1,))[0]
            self.heads[node] = heads
        return heads

    def same_last(self, node: int, last: int) -> int:
        """The first token seen that forbids the same merges to the entries below the node."""
        heads, crossing = self.heads_below(node) if node else (), []
        for x, made, used in self.spine(last, True) if last >= 0 else ():
            partners = self.partners.get(x, ())
            if node and len(heads) < len(partners):
                partners = [(y, self.merge_rank[x, y]) for y in heads if (x, y) in self.merge_rank]
            crossing += [(y, rank) for y, rank in partners if made < rank < used and (not node or y in heads)]
        key = pack([node, last < 0] + [x for pair in sorted(crossing) for x in pair])
        self.alike[(node << 32) + last] = alike = self.first_of.setdefault(key, last)
        return alike

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes are merged to it."""
        known = self.fits.get((token << 32) - 1)
        if known is None:
            a, b, rank = self.parts.get(token, (-1, -1, -1))
            known = a < 0 or self.is_whole(a) and self.is_whole(b) and all(
                not (max(mx, my) < self.merge_rank.get((x, y), 1 << 60) < ux and self.merge_rank[x, y] <= uy)
                for x, mx, ux in [(t, m, min(u, rank)) for t, m, u in self.spine(a, True)]
                for y, my, uy in [(t, m, min(u, rank - 1)) for t, m, u in self.spine(b, False)])
            self.fits[(token << 32) - 1] = known
        return known

    def step(self, row: np.ndarray, block: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Packed transitions; ``row`` holds state * ROW, a byte is given as its block of a row and its place there."""
        moved = self.moves.take(self.table.reshape(-1).take(row + block) + place)
        if np.minimum.reduce(moved, initial=0) < 0:
            new = moved < 0
            for i in np.unique((row[new] + block[new]) * BLOCK + place[new]):
                self.compile(int(i) >> 8, int(i) & 255)
            moved = self.moves.take(self.table.reshape(-1).take(row + block) + place)
        return moved

    # -- words

    def learn_classes(self, chars: np.ndarray) -> None:
        """Classes of new characters: with which of a letter, a digit and a mark does each form one word."""
        self.classes[chars] = SPACE_LIKE
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", MARK)):
            words = self.library.pre_tokenize_str("\n".join(probe + chr(c) for c in chars))
            joined = {a for _, (a, b) in words if b == a + 2 and a % 3 == 0}
            self.classes[[c for i, c in enumerate(chars) if 3 * i in joined]] = kind
        self.classes[ord(" ")] = SPACE

    def word_starts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters start a word; ``first`` marks the first character of each text."""
        kind = self.classes[chars]
        if (kind == UNSEEN).any():
            self.learn_classes(np.unique(chars[kind == UNSEEN]))
            kind = self.classes[chars]
        before = np.concatenate([[EDGE], kind[:-1]]).astype(np.uint8)
        before[first] = EDGE
        end = np.concatenate([first[1:], [True]])
        after = np.concatenate([kind[1:], [EDGE]]).astype(np.uint8)
        after[end] = EDGE
        blank, blank_before = kind >= SPACE_LIKE, (before == SPACE_LIKE) | (before == SPACE)
        # The last blank before other text is a word of its own, or, if a space, the head of that text's word.
        start = np.where(blank, ~blank_before | (after < SPACE_LIKE), (before != kind) & (before != SPACE))
        n = len(chars)
        for i in np.flatnonzero(start & (chars == ord("'"))):
            room = 1
            while room < 4 and i + room < n and not first[i + room]:
                room += 1
            tail = "".join(map(chr, chars[i + 1:i + min(room, 3)]))
            size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if size:
                start[i + 1:i + size] = False
                if size < room:
                    start[i + size] = True
        return start

    # -- running

    def layout(self, texts: list[str]):
        """Bytes and word starts of the texts, each padded to whole chunks; chunks of each text."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.zeros(len(chars), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        start = self.word_starts(chars, first)
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        begin = np.cumsum(width) - width
        raw = np.frombuffer(joined.encode(), np.uint8)
        total = np.concatenate([[0], np.cumsum(width)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        size = total[edge[1:]] - total[edge[:-1]]
        chunks = -(-size // CHUNK)
        shift = np.repeat((np.cumsum(chunks) - chunks) * CHUNK - total[edge[:-1]], size)
        where = np.arange(len(raw)) + shift
        symbol = np.full(int(chunks.sum()) * CHUNK, PAD, np.uint8)
        symbol[where] = raw
        starts = np.zeros(len(symbol), bool)
        starts[where[begin[start]]] = True
        return symbol.reshape(-1, CHUNK), starts.reshape(-1, CHUNK), chunks

    def run(self, symbol: np.ndarray, starts: np.ndarray, opening: np.ndarray, keep: bool):
        """Tokens that each chunk adds or, with ``keep``, the state after every byte."""
        lanes = len(symbol)
        columns = np.ascontiguousarray(symbol.T).astype(np.int32)
        blocks, places = columns // BLOCK, columns % BLOCK
        goes_on = np.ascontiguousarray(~starts.T) * np.int32(ROW)
        states = np.empty((CHUNK, lanes), np.int32) if keep else None
        state, added = np.full(lanes, UNKNOWN, np.int32), np.zeros(lanes, np.int64)
        for k in range(CHUNK):
            moved = self.step(state * goes_on[k], blocks[k], places[k])
            state = moved >> 8
            if keep:
                states[k] = state
            else:
                added += (moved & 255) - BIAS
        # The catch-up: bytes before the first word start of a chunk continue the chunk before it.
        has = starts.any(axis=1)
        head = np.where(has, starts.argmax(axis=1), CHUNK)
        head[opening] = 0
        known = has | opening
        waiting = np.flatnonzero(head > 0)
        while len(waiting):
            ready = waiting[known[waiting - 1]]
            waiting = waiting[~known[waiting - 1]]
            ready = ready[np.argsort(-head[ready], kind="stable")]
            now, left = state[ready - 1], head[ready]
            for k in range(int(left.max())):
                live = int(np.searchsorted(-left, -k, side="left"))
                at = ready[:live]
                moved = self.step(now[:live] * ROW, blocks[k, at], places[k, at])
                now[:live] = moved >> 8
                if keep:
                    states[k, at] = now[:live]
                else:
                    added[at] += (moved & 255) - BIAS
            state[ready] = np.where(has[ready], state[ready], now)
            known[ready] = True
        return added, states

    def parts_of(self, text: str):
        """Plain parts of a text and the ids of added tokens between them, in order."""
        pieces = [(text, None)]
        for content, token in self.added.items():
            nxt = []
            for plain, known in pieces:
                if known is not None or content not in plain:
                    nxt.append((plain, known))
                    continue
                split = plain.split(content)
                for i, s in enumerate(split):
                    nxt += [("", token)] * (i > 0) + [(s, None)]
            pieces = nxt
        return pieces

    def batches(self, texts: list[str | None]):
        """Groups of (text number, plain part or added id) of bounded size. Long parts are cut
        before a single space between two non-blanks, where a word starts whatever surrounds it."""
        group, size = [], 0
        for n, text in enumerate(texts):
            for plain, token in self.parts_of(text or ""):
                while True:
                    cut = len(plain)
                    if cut > BATCH_CHARS:
                        i = plain.find(" ", BATCH_CHARS)
                        while i > 0 and (plain[i - 1].isspace() or i + 1 >= len(plain) or plain[i + 1].isspace() or not plain[i - 1].isalnum() or not plain[i + 1].isalnum()):
                            i = plain.find(" ", i + 1)
                        cut = i if i > 0 else cut
                    group.append((n, plain[:cut], token))
                    size += cut
                    if size >= BATCH_CHARS:
                        yield group
                        group, size = [], 0
                    plain = plain[cut:]
                    if not plain:
                        break
        if group:
            yield group

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text; a null is an empty text."""
        out = np.zeros(len(texts), np.int64)
        for group in self.batches(texts):
            if len(self.keys) > MAX_STATES:
                self.restart()
            number = np.array([n for n, _, _ in group])
            np.add.at(out, number[[t is not None for _, _, t in group]], 1)
            symbol, starts, chunks = self.layout([p for _, p, _ in group])
            if len(symbol):
                opening = np.zeros(len(symbol), bool)
                opening[(np.cumsum(chunks) - chunks)[chunks > 0]] = True
                added, _ = self.run(symbol, starts, opening, keep=False)
                np.add.at(out, np.repeat(number, chunks), added)
        return out

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        out, size = [], np.zeros(len(texts), np.int64)
        for group in self.batches(texts):
            if len(self.keys) > MAX_STATES:
                self.restart()
            # An added token takes a chunk of its own, so that ids come out in order.
            symbol, starts, chunks = self.layout([p if t is None else "!" for _, p, t in group])
            if not len(symbol):
                continue
            first = np.cumsum(chunks) - chunks
            opening = np.zeros(len(symbol), bool)
            opening[first[chunks > 0]] = True
            _, states = self.run(symbol, starts, opening, keep=True)
            flat = self.last[np.ascontiguousarray(states.T).reshape(-1)]
            begin = np.flatnonzero(starts)
            used = (symbol != PAD).sum(axis=1)
            stop = np.repeat(first * CHUNK + np.add.reduceat(np.append(used, 0), np.minimum(first, len(used))) * (chunks > 0), chunks)
            text_end = stop[begin // CHUNK]
            end = np.minimum(np.append(begin[1:], 1 << 62), text_end) - 1
            found = np.full(len(flat), -1, np.int32)
            at = end
            while len(at):
                token = flat[at]
                found[at] = token
                at = at - self.length[token]
                live = at >= begin
                at, begin = at[live], begin[live]
            for i, (_, _, token) in enumerate(group):
                if token is not None:
                    found[first[i] * CHUNK] = token
            here = np.flatnonzero(found >= 0)
            out.append(found[here])
            np.add.at(size, np.repeat([n for n, _, _ in group], chunks)[here // CHUNK], 1)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), size


_compiled: dict[str, Transducer] = {}


def compiled(file: bytes) -> Transducer:
    """The transducer of a vocabulary file, kept by the worker process from task to task."""
    from hashlib import sha256

    key = sha256(file).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(file)
    return _compiled[key]
