"""Scores under a class-based bigram model whose classes come from exchange clustering.

Every training token is counted, whole texts, in a distributed table.  Classes
come from exchange.  At first, the most frequent words are
symbols of their own, other frequent words share a symbol with the words of
their frequency band, and all rarer words one symbol; symbol bigrams are counted
over all training texts, and one symbol after the other moves to the class that
raises the likelihood most.  Then, round after round, the classes before and
after each word are counted over all training texts, each word moves, by itself,
to the class that raises the likelihood most, and class transitions are counted
anew, until a round raises the training texts' likelihood by less than GAIN of
it.  The most frequent words, which move in these rounds, are a table that every
task holds; the others move once, under the classes that the rounds end with, and
stay a distributed table that is joined.  A token's probability is that of its class after the class
before, times that of the word in its class; both are smoothed.

Results in odd cases: null and empty texts have the end token alone; a null id
counts as held out; words that training lacks take
the class of the first round's rare words; without training rows every token is
unknown; rows that
repeat are counted and scored each; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_map, doc_crc, documents, forget, stored, text_bytes, tune
from .words import WordHashes

#: Words sent to every task (the others' classes and counts are joined), words with a symbol of their own, classes, sweeps.
FREQUENT, CORE, CLASSES, SWEEPS = 1 << 18, 512, 48, 6
BANDS = 64
#: Context counts that a task holds before it passes them on.
HELD = 1 << 21
#: Share of the log likelihood that a round of exchange must gain for another to follow.
GAIN = 0.005
#: Weight of the class's own frequency in a transition.
PRIOR = 5.0
#: The end of a text as a token; no word contains white space.
END, END_KEY = b"\n", 0x5851F42D4C957F2D


def words_of(data: bytes) -> list[bytes]:
    return [*data.lower().split(), END]


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(doc_crc(column), F.lit(7)) == 2, F.lit(True))


def word_key(word: bytes) -> int:
    return END_KEY if word == END else int(WordHashes()(word)[0])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, n: how often each word occurs; tasks count before anything is exchanged."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, counts = WordHashes(), [], []

        def out() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            key, n = np.unique(_tokens(batch.column(0), words)[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                key, n = out()
                keys, counts = [key], [n]
                if len(key) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])
                    keys, counts = [], []
        if keys:
            key, n = out()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select(text_col).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Symbols:
    """Which symbol the words sent to every task have; all others have the last one."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((keys, -counts))
        symbol = CORE + np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BANDS - 1)
        symbol[by_count[:CORE]] = np.arange(min(CORE, len(keys)))
        self.end, self.rare, self.size = CORE + BANDS, CORE + BANDS + 1, CORE + BANDS + 2
        symbol[keys == np.uint64(word_key(END))] = self.end
        order = np.argsort(keys)
        self.keys, self.counts, self.symbol = keys[order], counts[order], symbol[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Row in the table of each key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _tokens(column: pa.Array, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of a batch, and how many each text has."""
    keys, sizes = words.many(text_bytes(column))
    return np.insert(keys, np.cumsum(sizes), np.uint64(END_KEY)), sizes + 1


def _before(symbol: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The symbol before each token; texts begin after an end."""
    out = np.empty_like(symbol)
    out[1:] = symbol[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = end
    return out


def encode(docs: DataFrame, held, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, places (row in the table of each token, -1 for others), rare (keys of those others), row (a number of its own), written once and read by every later pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        symbols, words = held.value, WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes = _tokens(batch.column(2), words)
            place = symbols.place(keys)
            rare = place < 0
            ends = np.concatenate([[0], np.cumsum(sizes)])
            places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[ends].astype(np.int32)), pa.array(keys[rare].view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, others], ["id", "held_out", "places", "rare"])

        return step

    rows = docs.select(F.col(id_col), is_held_out.alias("__held"), F.col(text_col))
    out = arrow_map(rows, f"id {kind}, held_out boolean, places array<int>, rare array<bigint>", make)
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _places(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens of a batch, and how many each text has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def count_pairs(texts: DataFrame, held, size: int, end: int) -> np.ndarray:
    """Counts of neighbouring labels over all texts; held has the label of each place, as many as size, or is None where the one column of texts has labels.

    As many rows as label pairs come to the driver at most.
    """
    tune(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = held and held.value, np.zeros(size**2, np.int64)
        for batch in batches:
            place, sizes = _places(batch.column(0))
            if len(place):
                label = place.astype(np.int64) if own is None else own[place]
                total += np.bincount(_before(label, sizes, end) * size + label, minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(total[at[k : k + (1 << 16)]])], ["pair", "n"])

    table = texts.mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.float64)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol; the fixed one keeps class 0 to itself."""
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [int(w) for w in np.argsort(-weight, kind="stable") if w != fixed]
    label = np.zeros(n, np.int64)
    for rank, w in enumerate(order):
        label[w] = 1 + rank % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1
    held = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            c = label[w]
            after, before, self_ = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            after[c] -= self_
            before[c] -= self_
            # take the word out of its class
            held[c] -= after
            held[:, c] -= before
            held[c, c] -= self_
            rows, cols = held.sum(1), held.sum(0)
            gain = (_f(held + after) - _f(held)).sum(1) + (_f(held + before[:, None]) - _f(held)).sum(0)
            diag = np.diag(held)
            gain += _f(diag + after + before + self_) - _f(diag + after) - _f(diag + before) + _f(diag)
            out, into = after.sum() + self_, before.sum() + self_
            gain -= _f(rows + out) - _f(rows) + _f(cols + into) - _f(cols)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            member[w, c], member[w, best] = 0, 1
            label[w] = best
            held[best] += after
            held[:, best] += before
            held[best, best] += self_
            moved += best != c
        if not moved:
            break
    return label


class Model:
    """Log10 probabilities of classes and words; own has the class of each word in the table, and of all others last.

    others has tokens and types of each class among the words beyond the table, where each has a class of its own.
    """

    def __init__(self, symbols: Symbols, own: np.ndarray, pairs: np.ndarray, tokens: int, types: int, others: tuple[np.ndarray, np.ndarray] | None = None):
        self.symbols, self.own, self.end, self.pairs = symbols, own, 0, pairs
        count = np.bincount(own[:-1], symbols.counts, CLASSES)
        kinds = np.bincount(own[:-1], minlength=CLASSES).astype(float)
        if others is None:
            count[own[-1]] += tokens - symbols.counts.sum()
            kinds[own[-1]] += types - len(symbols.keys)
        else:
            count, kinds = count + others[0], kinds + others[1]
        share = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
        self.follow = np.log10((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))
        # one more word in each class stands for all that were never seen
        self.room = np.log10(count + kinds + 1)
        # of the training tokens under the classes, but for the words' own counts, which no class changes
        self.fit = float((pairs * self.follow).sum() - pairs.sum(0) @ self.room)


def first_model(symbols: Symbols, bigrams: np.ndarray, tokens: int, types: int) -> Model:
    """Classes of the symbols, which their words take over."""
    label = exchange(bigrams, symbols.end)
    member = np.zeros((symbols.size, CLASSES))
    member[np.arange(symbols.size), label] = 1
    return Model(symbols, label[np.append(symbols.symbol, symbols.rare)], member.T @ bigrams @ member, tokens, types)


def best_class(model: Model, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The likeliest class of words; seen has how often each class came before and after each."""
    score = seen[:, :CLASSES] @ model.follow + seen[:, CLASSES:] @ model.follow.T - counts[:, None] * model.room
    score[:, model.end] = -np.inf
    return score.argmax(1).astype(np.int32)


def exchanged(learned: DataFrame, first: Model, tokens: int, types: int) -> Model:
    """The model after rounds of exchange over all words of the table, each under the classes of the round before."""
    share, model = partial(Shared, learned.sparkSession), first
    while True:
        own = choose_classes(learned, share(model))
        pairs = count_pairs(learned.select("places"), share(own), CLASSES, model.end)
        after = Model(model.symbols, own, pairs, tokens, types)
        if after.fit <= model.fit:
            return model
        gained, model = after.fit - model.fit, after
        if gained < GAIN * abs(after.fit):
            return model


def choose_rare(encoded: DataFrame, held) -> DataFrame:
    """key, label, n: the class of each word beyond the table, chosen like those in it, and how often it occurs; nothing of it comes to the driver.

    A word beyond the table is none of the FREQUENT most frequent, so no key is hot; counts of one are CLASSES ** 2 rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            place, sizes = _places(batch.column(0))
            # texts end with the end, which the table has, so a rare word has a word after it
            at = np.flatnonzero(place < 0)
            if not len(at):
                continue
            label = model.own[place]
            around = _before(label, sizes, model.end)[at] * CLASSES + label[at + 1]
            keys = batch.column(1).flatten()
            for k in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([keys[k : k + (1 << 16)], pa.array(around[k : k + (1 << 16)].astype(np.int32))], ["key", "around"])

    def make():
        model = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            seen = np.zeros((batch.num_rows, 2 * CLASSES))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            around, n = (x.to_numpy() for x in lists.flatten().flatten())
            np.add.at(seen, (row, around // CLASSES), n)
            np.add.at(seen, (row, CLASSES + around % CLASSES), n)
            counts = seen[:, :CLASSES].sum(1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_class(model, seen, counts)), pa.array(counts.astype(np.int64))], ["key", "label", "n"])

        return step

    tune(encoded.sparkSession)
    seen = encoded.select("places", "rare").mapInArrow(run, "key bigint, around int")
    lists = seen.groupBy("key", "around").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.collect_list(F.struct("around", "n")).alias("seen"))
    return stored(arrow_map(lists, "key bigint, label int, n bigint", make), "rare-classes")


def labelled(encoded: DataFrame, rare: DataFrame, held) -> DataFrame:
    """id, held_out, labels (class of each token), n_known, known (sum of log10 of the tokens' counts and one); held has the classes and counts of the table."""
    kind = encoded.schema["id"].dataType.simpleString()
    asked = encoded.select("row", F.explode(F.array_distinct("rare")).alias("key"))
    found = asked.join(rare, "key").groupBy("row").agg(F.collect_list(F.struct("key", "label", "n")).alias("found"))

    def make():
        own, counts = held.value
        in_table = np.append(np.log10(counts + 1.0), 0.0)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            place, sizes = _places(batch.column(2))
            label, known, seen = own[place].astype(np.int32), in_table[place], place >= 0
            keys, classes, n = (x.to_numpy() for x in batch.column(4).flatten().flatten())
            if len(keys):
                # a word that isn't found was never seen and adds log10(1)
                keys, first = np.unique(keys, return_index=True)
                asks = batch.column(3).flatten().to_numpy()
                at = np.minimum(np.searchsorted(keys, asks), len(keys) - 1)
                hit = keys[at] == asks
                at, to = first[at[hit]], np.flatnonzero(~seen)[hit]
                label[to], known[to], seen[to] = classes[at], np.log10(n[at] + 1.0), True
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            add = lambda x: np.add.reduceat(x, ends[:-1]) if len(x) else x
            labels = pa.ListArray.from_arrays(pa.array(ends), pa.array(label))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), labels, pa.array(add(seen.astype(np.int64))), pa.array(add(known))], ["id", "held_out", "labels", "n_known", "known"])

        return step

    both = encoded.join(found, "row", "left").select("id", "held_out", "places", "rare", "found")
    return stored(arrow_map(both, f"id {kind}, held_out boolean, labels array<int>, n_known bigint, known double", make), "labelled")


def choose_classes(encoded: DataFrame, held) -> np.ndarray:
    """The class of each word of the table under which its own neighbours and frequency are likeliest; the end keeps its class.

    A word's counts are 2 * CLASSES at most from each task, so no word is a hot key; one row a word comes back.
    """

    def merge(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes, counts = held.value, [], []

        def out() -> Iterator[pa.RecordBatch]:
            code, n = merge(codes, counts)
            for k in range(0, len(code), 1 << 16):
                part = code[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((part // (2 * CLASSES)).astype(np.int32)), pa.array((part % (2 * CLASSES)).astype(np.int32)), pa.array(n[k : k + (1 << 16)])], ["word", "slot", "n"])

        for batch in batches:
            place, sizes = _places(batch.column(0))
            if not len(place):
                continue
            place = place.astype(np.int64)
            label = model.own[place]
            before = place >= 0
            after = before[:-1].copy()
            after[np.cumsum(sizes)[:-1] - 1] = False
            code = [place[before] * (2 * CLASSES) + _before(label, sizes, model.end)[before], place[:-1][after] * (2 * CLASSES) + CLASSES + label[1:][after]]
            code, n = np.unique(np.concatenate(code), return_counts=True)
            codes.append(code)
            counts.append(n)
            if sum(map(len, codes)) > HELD:
                code, n = merge(codes, counts)
                codes, counts = [code], [n]
                if len(code) > HELD // 2:
                    yield from out()
                    codes, counts = [], []
        if codes:
            yield from out()

    def make():
        model = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            word, lists = batch.column(0).to_numpy(), batch.column(1)
            seen = np.zeros((len(word), 2 * CLASSES))
            row = np.repeat(np.arange(len(word)), lists.value_lengths().to_numpy())
            slot, n = lists.flatten().flatten()
            seen[row, slot.to_numpy()] = n.to_numpy()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_class(model, seen, model.symbols.counts[word]))], ["word", "label"])

        return step

    tune(encoded.sparkSession)
    # tasks have counted already what they pass on
    seen = encoded.select("places").mapInArrow(run, "word int, slot int, n bigint").repartition("word")
    lists = seen.groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("seen"))
    table = arrow_map(lists, "word int, label int", make).toArrow()
    model = held.value
    own = model.own.copy()
    own[table["word"].to_numpy()] = table["label"].to_numpy()
    own[:-1][model.symbols.symbol == model.symbols.end] = model.end
    return own


def lm_scores(docs: DataFrame, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    tune(spark)
    train = docs.where(~is_held_out)
    counts = stored(count_words(train, text_col), "word-counts")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = int(size["n"]), int(size["v"])
    # the least count of which there are no more than FREQUENT words, from a histogram of a few hundred rows
    step = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        held += r["words"]
        if held > FREQUENT:
            least = r["step"] + 1
            break
    end = int(np.uint64(word_key(END)).astype(np.int64))
    top = counts.where((step >= least) | (F.col("key") == end)).orderBy(F.desc("n"), "key").toArrow()
    forget(counts)
    symbols = Symbols(top["key"].to_numpy().view(np.uint64), top["n"].to_numpy())
    share = partial(Shared, spark)
    encoded = encode(docs, share(symbols), is_held_out, id_col, text_col)
    learned = encoded.where(~F.col("held_out"))
    bigrams = count_pairs(learned.select("places"), share(np.append(symbols.symbol, symbols.rare)), symbols.size, symbols.end)
    first = first_model(symbols, bigrams, tokens, types)
    best = exchanged(learned, first, tokens, types)
    own = best.own
    rare = choose_rare(learned, share(best))
    others = np.zeros((2, CLASSES))
    for r in rare.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        others[:, r["label"]] = r["n"], r["words"]
    texts = labelled(encoded, rare, share((own, symbols.counts)))
    forget(encoded)
    forget(rare)
    pairs = count_pairs(texts.where(~F.col("held_out")).select("labels"), None, CLASSES, best.end)
    final = Model(symbols, own, pairs, tokens, types, (others[0], others[1]))
    held = share((final.follow, final.room, final.end))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        follow, word, end = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            label, sizes = _places(batch.column(2))
            prior = _before(label, sizes, end) if len(label) else label
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            score = np.add.reduceat(follow[prior, label] - word[label], starts) if len(label) else np.empty(0)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), *batch.columns[3:], pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "known", "score"])

        return step

    rows = arrow_map(texts, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, known double, score double", make)
    room = float(np.log10(tokens + types + 1))
    return rows.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("known") - F.col("n_tokens") * F.lit(room)).alias("base_score"), (F.col("score") + F.col("known")).alias("score"),
    )


def op3_class_lm(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir), held_out())
