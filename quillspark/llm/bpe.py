"""BPE encoding and decoding by speculation and verification (operator 9).

Greedy longest match proposes each distinct word's tokens; a proposal is the true encoding exactly
when every adjacent pair of its tokens is what BPE makes of the pair's own string, so all pairs of a
block of words are tested at once against the known ones and only words with an incompatible pair
are merged exactly. Words already seen are looked up in a bounded two-generation cache.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import slices
from .store import columns, table, unused

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
NEVER = 1 << 60


# Code points that the tokenizers library's Unicode tables know as neither letters nor
# numbers, while the regex module's newer ones do (first, last).
NOT_YET = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf),
    (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf),
    (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1),
    (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff3), (0x16ff4, 0x16ff6),
    (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128),
    (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de),
    (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e),
    (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
# Code points that it lower-cases while Python's older tables don't (first, last, step).
LOWERED = [
    (0x1c89, 0x1c89, 1), (0xa7cb, 0xa7cb, -42343), (0xa7cc, 0xa7cc, 1), (0xa7ce, 0xa7ce, 1), (0xa7d2, 0xa7d2, 1), (0xa7d4, 0xa7d4, 1),
    (0xa7da, 0xa7da, 1), (0xa7dc, 0xa7dc, -42561), (0x10d50, 0x10d65, 32), (0x16ea0, 0x16eb8, 27),
]
_class = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NOT_YET) + "]"
SPECIAL_CASE = regex.compile("[" + _class[1:-1] + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, _ in LOWERED) + "]")
LOWER_LATE = {c: c + step for a, b, step in LOWERED for c in range(a, b + 1)}


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}


class WordBpe:
    """An encoder and decoder for a BPE tokenizer file with word ends."""

    #: Words and token pairs remembered by a worker; longest word merged in rounds.
    CACHE, PAIRS, LONG = 250_000, 1_000_000, 100

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.text = [named.get(i, "") for i in range(max(named) + 1)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        late = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--{_class}]").replace("|[\\p{N}]|", rf"|[\p{{N}}--{_class}]|").replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{_class}]")
        self.late_words = regex.compile(late, regex.V1).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.table = byte_alphabet()
        self.pair_ok: dict[int, bool] = {}
        self.new: dict[str, tuple] = {}
        self.old: dict[str, bytes] = {}
        self._tables()
        self.counts = {"words": 0, "merged": 0}

    def pieces(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        plain = self.normal(text)
        if not text.isascii() and SPECIAL_CASE.search(plain):
            return self.late_words(plain.translate(LOWER_LATE))
        return self.words(plain)

    def normal(self, text: str) -> str:
        """NFC and lower case character by character (so without the final-sigma rule of whole-string
        lower-casing). White space needs no normalising: the word pattern drops it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def units(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.table)

    def _tables(self) -> None:
        """Arrays of the vocabulary's trie and of the merges, for the vectorised steps."""
        nodes: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        mid, end = [-1], [-1]
        for token, i in self.vocab.items():
            bare = token.removesuffix(END) or token
            node = 0
            for k in range(1, len(bare) + 1):
                child = nodes.get(bare[:k])
                if child is None:
                    child = nodes[bare[:k]] = len(nodes)
                    edges[node << 9 | ord(bare[k - 1])] = child
                    mid.append(-1)
                    end.append(-1)
                node = child
            (end if bare is not token and len(bare) < len(token) else mid)[node] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edge.tolist()], np.int64)
        self.mid, self.end = np.array(mid), np.array(end)
        codes = sorted((self.vocab[a] << 16 | self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.rank.items())
        self.pair, self.pair_rank, self.pair_to = (np.array(x, np.int64) for x in zip(*codes))
        one = np.full((2, 512), -1)
        for c in self.table.values():
            one[0, c], one[1, c] = self.vocab[chr(c)], self.vocab[chr(c) + END]
        self.one = one

    def greedy(self, unit: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left in every word at once (the last token must carry the word
        end): all tokens in order, and the word of each."""
        token = np.full(len(unit), -1, np.int64)
        start = off[:-1].copy()
        stop = off[1:]
        at, node = start.copy(), np.zeros(len(start), np.int64)
        best, best_at = np.full(len(start), -1, np.int64), start.copy()
        while len(start):
            inside = at < stop
            code = node << 9 | unit[np.where(inside, at, 0)]
            k = np.minimum(np.searchsorted(self.edge, code), len(self.edge) - 1)
            went = inside & (self.edge[k] == code)
            node = np.where(went, self.child[k], node)
            at = at + went
            found = np.where(at == stop, self.end[node], self.mid[node])
            better = went & (found >= 0)
            best, best_at = np.where(better, found, best), np.where(better, at, best_at)
            done = ~went
            token[start[done]] = best[done]
            start, at = np.where(done, best_at, start), np.where(done, best_at, at)
            node, best = np.where(done, 0, node), np.where(done, -1, best)
            alive = start < stop
            if not alive.all():
                start, stop, at, node, best, best_at = (x[alive] for x in (start, stop, at, node, best, best_at))
        kept = token >= 0
        return token[kept], np.repeat(np.arange(len(off) - 1), np.diff(off))[kept]

    def merge(self, unit: np.ndarray, off: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of every word at once: in each round each word merges its adjacent pair of
        lowest rank, leftmost first, until none can be merged. ``ended``: words with a word end."""
        n = np.diff(off)
        last = np.zeros(len(unit), np.int64)
        last[off[1:][ended] - 1] = 1
        ids, word = self.one[last, unit], np.repeat(np.arange(len(n)), n)
        out_ids, out_word = [], []
        while len(ids):
            code = ids[:-1] << 16 | ids[1:]
            k = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            can = (self.pair[k] == code) & (word[:-1] == word[1:])
            key = np.where(can, self.pair_rank[k] * len(ids) + np.arange(len(code)), NEVER)
            least = np.full(len(n), NEVER, np.int64)
            np.minimum.at(least, word[:-1], key)
            busy = least[word] < NEVER
            out_ids.append(ids[~busy])
            out_word.append(word[~busy])
            i = least[least < NEVER] % len(ids)
            ids = ids.copy()
            ids[i] = self.pair_to[k[i]]
            busy[i + 1] = False
            ids, word = ids[busy], word[busy]
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def merge_long(self, word: str) -> list[int]:
        """Exact BPE of one very long word, with a heap of its pairs."""
        units = list(word)
        units[-1] += END
        n = len(units)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.rank
        heap = [(r, i, units[i], units[i + 1]) for i in range(n - 1) if (r := rank.get((units[i], units[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or units[i] != a or units[j] != b:
                continue
            units[i], units[j] = a + b, ""
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (r := rank.get((units[i], units[k]))) is not None:
                    heapq.heappush(heap, (r, i, units[i], units[k]))
            if (h := prv[i]) >= 0 and (r := rank.get((units[h], units[i]))) is not None:
                heapq.heappush(heap, (r, h, units[h], units[i]))
        return [self.vocab[u] for u in units if u]

    @staticmethod
    def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        off = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=off[1:])
        return np.frombuffer("".join(words).encode("utf-16-le"), "<u2").astype(np.int64), off

    def _test(self, codes: list[int]) -> None:
        """Learn whether BPE gives the token alone (a code of one token) or the two tokens back."""
        said = [[self.text[c & 0xFFFF]] if c < 1 << 16 else [self.text[(c >> 16) - 1], self.text[c & 0xFFFF]] for c in codes]
        strings = ["".join(t) for t in said]
        ended = np.array([s.endswith(END) and len(s) > len(END) for s in strings])
        ids, word = self.merge(*self.flat([s.removesuffix(END) if e else s for s, e in zip(strings, ended)]), ended)
        off = np.searchsorted(word, np.arange(len(codes) + 1))
        for k, t in enumerate(said):
            self.pair_ok[codes[k]] = [self.text[i] for i in ids[off[k] : off[k + 1]].tolist()] == t

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache doesn't hold."""
        if not words:
            return
        strings = [self.units(w) for w in words]
        unit, off = self.flat(strings)
        ids, owner = self.greedy(unit, off)
        first = np.ones(len(ids), bool)
        first[1:] = owner[1:] != owner[:-1]
        alone = first & np.append(first[1:], True)
        code = np.where(alone, ids, (np.append(0, ids[:-1]) + 1) << 16 | ids)
        code[first & ~alone] = -1  # the first token of several is tested with the next
        if len(self.pair_ok) > self.PAIRS:
            self.pair_ok = {}
        self.pair_ok[-1] = True
        distinct, at = np.unique(code, return_inverse=True)
        unknown = [c for c in distinct.tolist() if c not in self.pair_ok]
        if unknown:
            self._test(unknown)
        good = np.fromiter(map(self.pair_ok.__getitem__, distinct.tolist()), bool, len(distinct))[at]
        fails = np.bincount(owner[~good], minlength=len(words)) > 0
        redo = [strings[k] for k in np.flatnonzero(fails & (np.diff(off) <= self.LONG))]
        found = {}
        if redo:
            ids2, owner2 = self.merge(*self.flat(redo), np.ones(len(redo), bool))
            cut2, raw2 = (4 * np.searchsorted(owner2, np.arange(len(redo) + 1))).tolist(), ids2.astype("<u4").tobytes()
            found = {s: raw2[cut2[k] : cut2[k + 1]] for k, s in enumerate(redo)}
        cut, raw = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist(), ids.astype("<u4").tobytes()
        new = self.new
        for k, (w, bad) in enumerate(zip(words, fails.tolist())):
            new[w] = raw[cut[k] : cut[k + 1]] if not bad else found.get(strings[k]) or np.array(self.merge_long(strings[k]), "<u4").tobytes()
        self.counts["words"] += len(words)
        self.counts["merged"] += int(np.count_nonzero(fails))

    def encode_many(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text (null: empty) its ids, 4 bytes each, and what decoding them gives."""
        parts = []
        for text in texts:
            parts.append([])
            for i, piece in enumerate(self.split_special(text or "")):
                parts[-1].append(piece if i % 2 else self.pieces(piece))
        missing: set[str] = set()
        for pieces in parts:
            for p in pieces:
                if isinstance(p, list):
                    missing.update(p)
        if len(self.new) > self.CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = {w for w in missing if w not in new}
        again = {w: old[w] for w in missing if w in old}
        new.update(again)
        self.learn(list(missing - again.keys()))
        out, text = [], self.text
        for pieces in parts:
            ids: list[bytes] = []
            for p in pieces:
                if isinstance(p, str):
                    ids.append(self.special[p].to_bytes(4, "little"))
                else:
                    ids.extend(map(new.__getitem__, p))
            raw = b"".join(ids)
            out.append((raw, " ".join([text[i] for i in np.frombuffer(raw, "<u4").tolist()])))
        return out


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str | None = None) -> WordBpe:
    """The worker's encoder for a vocabulary file; by default the public one of the package
    installed beside the worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: the ``keep`` columns, ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit integers) and ``decoded``.

    Each row stands alone: no shuffle, whole texts, repeated rows encoded each. Null and empty
    texts have no tokens and decode to the empty string. Special tokens' strings in a text are the
    special tokens. Columns not in ``keep`` don't matter, whatever their names.
    """
    kept = docs.select(*columns(keep))
    schema = kept.schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")
    (own,) = unused(kept, "text")
    names = [f.name for f in schema.fields]

    def run(batches):
        bpe = tokenizer(path)
        for part in slices(batches, own, 1 << 20):
            got = bpe.encode_many(part.column(own).to_pylist())
            out = [part.column(k) for k in keep]
            out += [pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(*columns(keep), F.col(text).alias(own)).mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), ["doc_id"])
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
