"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text of every language. A text is then cut, from left to
right, into the longest phrases that occur in a language's sample: the automaton walks on while it can, and starts a new
phrase where it can't. Phrase counts of samples of different lengths and languages of different richness don't compare, so
they are normalised by the number of phrases that a text of the language itself needs for as many letters, which
cross-validation on the sample tells; the language needing fewest normalised phrases wins. Automata are transition tables,
dense for the most frequent letters and sorted lists for all others, so that numpy walks thousands of text pieces through
them in lockstep.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import fold

#: Letters of sample a language (a documented bound), and how much of one text may enter it.
SAMPLE, FROM_ONE_TEXT = 24_000, 1_500
#: Parts of a sample that are parsed by the others to learn how many phrases a language's own text needs.
PARTS = 4
#: Letters with columns of their own in the tables, fewer where many languages would make the tables larger than so many
#: entries; transitions by other letters are looked up in a sorted list, with the same result.
ALPHABET, ENTRIES = 62, 1 << 26
#: Languages that are learned, those with most labelled texts (a documented bound on the sample: this times SAMPLE letters).
LANGUAGES = 4_096
#: Letters of a text that are walked one after the other; its pieces are walked side by side and then joined up.
PIECE = 2_048
GAP, UNKNOWN = 0, 1


def clean(text: str) -> str:
    """Lower case, every run of characters that are no letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton of one string over small integers, as a table next[state, symbol] (-1: none); the root is 0.

    Transitions by symbols of width and above are rows (state, symbol, to) of ``rare``.
    """

    def __init__(self, symbols: list[int], width: int):
        after: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and c not in after[at]:
                after[at][c] = new
                at = link[at]
            if at != -1:
                to = after[at][c]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    copy = len(after)
                    after.append(dict(after[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at != -1 and after[at].get(c) == to:
                        after[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        self.next = np.full((len(after), width), -1, np.int32)
        rare = []
        for state, edges in enumerate(after):
            for c, to in edges.items():
                if c < width:
                    self.next[state, c] = to
                else:
                    rare.append((state, c, to))
        self.rare = np.array(rare, np.int64).reshape(-1, 3)


class Model:
    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(k for k in samples if samples[k].strip())
        samples = {k: samples[k] for k in self.languages}
        letters = Counter("".join(samples.values()))
        letters.pop(" ", None)
        known = sorted(letters, key=lambda c: (-letters[c], c))
        self.code = np.array([UNKNOWN if chr(i).isalpha() else GAP for i in range(0x110000)], np.uint32)
        for i, c in enumerate(known):
            self.code[ord(c)] = i + 2
        self.symbols = len(known) + 2
        states = 2 * sum(map(len, samples.values()))
        self.width = max(0, min(len(known), ALPHABET, ENTRIES // max(1, states) - 2)) + 2
        encoded = [self.encode(samples[k]) for k in self.languages]
        self.own = np.array([self.own_rate(x) for x in encoded])
        self.load(encoded)

    def load(self, samples: list[np.ndarray]) -> None:
        """The automata of encoded samples, one below the other, so that one walk serves all languages."""
        automata = [Automaton(x.tolist(), self.width) for x in samples]
        tables = [a.next for a in automata]
        for t in tables:
            t[:, UNKNOWN] = -1
        self.roots = np.cumsum([0, *[len(t) for t in tables[:-1]]]).astype(np.int32)
        self.table = np.concatenate([np.where(t >= 0, t + r, -1) for t, r in zip(tables, self.roots, strict=True)]).astype(np.int32)
        # state * symbols + symbol, sorted, and the states they lead to.
        rare = np.concatenate([a.rare + [r, 0, r] for a, r in zip(automata, self.roots, strict=True)])
        keys = rare[:, 0] * self.symbols + rare[:, 1]
        order = np.argsort(keys)
        self.rare_keys, self.rare_to = keys[order], rare[order, 2].astype(np.int32)

    def own_rate(self, sample: np.ndarray) -> float:
        """Phrases a letter that a language's own text needs: parts of its sample parsed by the rest, the median of stretches.

        Phrases grow with the logarithm of the sample, so the rate of a shorter sample is carried over to the whole one.
        """
        stretches = [sample[i : i + 200] for i in range(0, len(sample), 200)]
        if len(stretches) < PARTS:
            stretches = np.array_split(sample, PARTS)
        rates = []
        for part in range(PARTS):
            tried = [x for x in stretches[part::PARTS] if len(x)]
            rest = [x for i, x in enumerate(stretches) if i % PARTS != part and len(x)]
            if not tried or not rest:
                continue
            self.load([np.concatenate(rest)])
            longer = np.log(2 + sum(map(len, rest))) / np.log(2 + len(sample))
            rates += [(n / len(x) * longer, len(x)) for n, x in zip(self.phrases(tried)[:, 0].tolist(), tried, strict=True)]
        if not rates:
            return 1.0
        rates.sort()
        reach = np.cumsum([n for _, n in rates])
        return rates[int(np.searchsorted(reach, reach[-1] / 2))][0]

    def after(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that rare symbols lead to, -1 where none."""
        keys = state.astype(np.int64) * self.symbols + symbol
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == keys, self.rare_to[at], -1)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a whole text in lower case; a run of characters that are no letters is one GAP, at the ends none."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = codes != GAP
        codes = codes[letter | np.r_[False, letter[:-1]]]
        return codes[:-1] if len(codes) and codes[-1] == GAP else codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of every encoded text (row) in every language (column), each text cut from left to right as a whole.

        Long texts are walked in pieces side by side, each as if a phrase began with it. A piece is then walked again from
        the state in which the piece before it really ends, until both walks are in the same state, after which they are
        one. Only where they never meet, the piece after it has to be looked at again too.
        """
        pieces, owner = [], []
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), PIECE):
                pieces.append(codes[at : at + PIECE])
                owner.append(i)
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        if not pieces:
            return out
        owner = np.array(owner)
        stops, ends = np.zeros((len(pieces), len(self.roots)), np.int64), np.zeros((len(pieces), len(self.roots)), np.int32)
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), 2048):
            part = order[lo : lo + 2048]
            stops[part], ends[part] = self._walk([pieces[i] for i in part])
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        if len(follows):
            begun = np.repeat(self.roots[None, :], len(pieces), 0)
            while len(follows):
                start = ends[follows - 1]
                new = (start != begun[follows]).any(1)
                follows, start = follows[new], start[new]
                if not len(follows):
                    break
                before = ends[follows].copy()
                for lo in range(0, len(follows), 2048):
                    part = follows[lo : lo + 2048]
                    more, last, met = self._rejoin([pieces[i] for i in part], begun[part], start[lo : lo + 2048])
                    stops[part] += more
                    ends[part] = np.where(met, ends[part], last)
                begun[follows] = start
                moved = follows[(ends[follows] != before).any(1)] + 1
                follows = moved[(moved < len(owner)) & (owner[np.minimum(moved, len(owner) - 1)] == owner[moved - 1])]
        np.add.at(out, owner, stops)
        out[np.unique(owner)] += 1  # the first phrase
        return out

    def _fresh(self) -> np.ndarray:
        """symbol -> state after it as the first of a phrase, for every language."""
        first = self.table[self.roots]
        if self.symbols > self.table.shape[1]:
            others = np.arange(self.table.shape[1], self.symbols)[None, :]
            first = np.concatenate([first, self.after(self.roots[:, None], others)], 1)
        return np.where(first >= 0, first, self.roots[:, None]).T

    def _step(self, state: np.ndarray, symbol: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after a symbol, where a new phrase began with it)."""
        width = self.table.shape[1]
        to = self.table.ravel()[state.astype(np.int64) * width + np.minimum(symbol, width - 1)[:, None]]
        rare = np.flatnonzero(symbol >= width)
        if len(rare):
            to[rare] = self.after(state[rare], symbol[rare, None])
        stop = to < 0
        return np.where(stop, fresh[symbol], to), stop

    def _walk(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin within, last state) of each piece, longest first, from the root."""
        size = np.array([len(p) for p in pieces])
        grid = np.zeros((int(size[0]), len(size)), np.uint32)
        for k, p in enumerate(pieces):
            grid[: size[k], k] = p
        state, count, fresh = np.repeat(self.roots[None, :], len(size), 0), np.zeros((len(size), len(self.roots)), np.int64), self._fresh()
        alive = np.searchsorted(-size, -np.arange(1, len(grid) + 1), side="right")
        for t, n in enumerate(alive):
            state[:n], stop = self._step(state[:n], grid[t, :n], fresh)
            count[:n] += stop
        return count, state

    def _rejoin(self, pieces: list[np.ndarray], was: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases more than from the state ``was``, last state, whether both walks met) of each piece and language, from ``start``."""
        fresh, on, size = self._fresh(), np.arange(len(pieces)), np.array([len(p) for p in pieces])
        grid = np.zeros((int(size.max()), len(size)), np.uint32)
        for k, p in enumerate(pieces):
            grid[: size[k], k] = p
        more, last, met = np.zeros(start.shape, np.int64), start.copy(), was == start
        was, state = was.copy(), start.copy()
        for t, symbols in enumerate(grid):
            on = on[(t < size[on]) & ~met[on].all(1)]
            if not len(on):
                break
            symbol = symbols[on]
            old, old_stop = self._step(was[on], symbol, fresh)
            new, new_stop = self._step(state[on], symbol, fresh)
            more[on] += np.where(met[on], 0, new_stop.astype(np.int64) - old_stop)
            met[on] |= old == new
            was[on], state[on], last[on] = old, new, new
        return more, last, met


def train(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Model | None:
    """Learn from a bounded sample of labelled texts, seeded by doc_id; None where no text is labelled.

    What reaches the driver is about sample letters a language, for the ``most`` languages with most labelled texts. Equal
    pieces enter a sample once. Rows with a null text, a null lang or without a letter are not learned from.
    """
    labelled = docs.filter("lang is not null and text is not null").select("lang", "doc_id", "text")
    labelled = labelled.filter(F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64("doc_id", "text"))
    size = F.least(F.length("text"), F.lit(FROM_ONE_TEXT))
    counts = {r.lang: (r.n, r.size) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.avg(size).alias("size")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    # Enough texts of each language by a threshold on the draw; no sort, no window. Some of what is drawn are no letters.
    want = {k: 2 * sample / size + 50 for k, (_, size) in counts.items()}
    limit = F.from_json(F.lit(json.dumps({k: min(1.0, want[k] / n) for k, (n, _) in counts.items()})), "map<string,double>")
    part = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    # A piece from anywhere in the text, by the draw; what isn't a letter doesn't count.
    letters = F.trim(F.regexp_replace("text", r"\P{L}+", " "))
    begin = F.pmod(F.xxhash64("draw"), F.greatest(F.length("letters") - FROM_ONE_TEXT, F.lit(0)) + 1) + 1
    drawn = labelled.filter(part < limit[F.col("lang")]).select("lang", "draw", letters.alias("letters"))
    rows = drawn.select("lang", "draw", F.col("letters").substr(begin.cast("int"), F.lit(FROM_ONE_TEXT)).alias("text")).orderBy("lang", "draw").limit(int(2 * sum(want.values()))).collect()
    pieces: dict[str, dict[str, None]] = {k: {} for k in counts}
    held = dict.fromkeys(counts, 0)
    for r in rows:
        text = clean(r.text)
        if held[r.lang] < sample and text not in pieces[r.lang]:
            pieces[r.lang][text] = None
            held[r.lang] += len(text) + 1
    samples = {k: " ".join(v)[:sample] for k, v in pieces.items()}
    return Model(samples) if any(v.strip() for v in samples.values()) else None


def language_of(docs: DataFrame, model: Model | None, out: str = "language") -> DataFrame:
    """Add a struct (lang_pred, score, phrases, letters): und and 0 where the text is null or has no letter.

    score is the winner's share of the inverse normalised counts, 0 to 1; phrases are the winner's, not normalised. Ties go
    to the first language in order. Extra columns stay; repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, phrases long, letters long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            rows = []
            for lo in range(0, len(texts), 1024):
                encoded = [m.encode(x) if x and m else np.zeros(0, np.uint32) for x in texts.iloc[lo : lo + 1024]]
                counts = m.phrases(encoded) if m else None
                relative = counts / m.own if m else None
                for i, x in enumerate(encoded):
                    if not len(x) or m is None:
                        rows.append(("und", 0.0, 0, 0))
                        continue
                    best = int(relative[i].argmin())
                    inverse = 1.0 / relative[i]
                    rows.append((m.languages[best], float(inverse[best] / inverse.sum()), int(counts[i][best]), len(x)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "phrases", "letters"])

    return docs.withColumn(out, predict.asNondeterministic()(F.col("text")))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out.

    A null doc_id is not held out. Repeated rows each get a row; an empty table gives none.
    """
    held = fold(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~held))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return language_of(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score")
