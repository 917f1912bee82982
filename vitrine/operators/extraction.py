"""Names out of texts by dictionary: four tiers of matches, their priority, and comparisons between corpora."""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import preprocess
from vitrine.operators.dictionary import of_names as build_dictionary  # noqa: F401
from vitrine.operators.staging import single_rows, staged

#: Bytes of the phrases, and of other entries of a dictionary, that are in every task at once; rows of a batch of matches.
PHRASE_BYTES, BATCH_ROWS = 1 << 23, 1 << 16
#: Bytes of the triggers that a scan has in a task at once (a trie takes about thirty for each); characters of texts that it
#: looks at together; words whose misreadings a worker remembers.
ENTRY_BYTES, GROUP_CHARS, KEPT_WORDS = 1 << 24, 1 << 20, 1 << 18
#: Words of two or more capitals, with an optional apostrophe part.
WORD = re.compile("[A-Z]{2,}(?:'[A-Z]+)?")


def _gathered(texts: DataFrame) -> DataFrame:
    """(item_id, texts): each item's texts in upper case.  Only the texts are moved, never their words."""
    return texts.groupBy("item_id").agg(F.collect_list(F.upper("text")).alias("texts"))


def _counted(texts: list[str]) -> Counter:
    counts = Counter()
    for text in texts:
        counts.update(WORD.findall(text))
    return counts


def words_of(texts: DataFrame) -> DataFrame:
    """(item_id, word, reps): upper-case words of the texts (item_id, text) and how often they occur.  An item's words are
    counted where its texts are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, reps = [], [], []
            for r, said in enumerate(batch.column(1).to_pylist()):
                counts = _counted(said)
                rows.extend([r] * len(counts))
                words.extend(counts.keys())
                reps.extend(counts.values())
                if len(rows) >= BATCH_ROWS:
                    yield _taken(batch, rows, word=pa.array(words, pa.string()), reps=pa.array(reps, pa.int64()))
                    rows, words, reps = [], [], []
            yield _taken(batch, rows, word=pa.array(words, pa.string()), reps=pa.array(reps, pa.int64()))

    kind = dict(texts.dtypes)["item_id"]
    return _gathered(texts).mapInArrow(count, f"item_id {kind}, word string, reps long")


def _taken(batch: pa.RecordBatch, rows: list[int], **columns: pa.Array) -> pa.RecordBatch:
    """The ids of a batch's rows, beside columns with what was found in them."""
    ids = batch.column(0).take(pa.array(rows, pa.int64()))
    return pa.record_batch([ids, *columns.values()], names=["item_id", *columns])


def vocabulary_of(texts: DataFrame) -> DataFrame:
    """(word): the different upper-case words of the texts (item_id, text); a batch gives each of its words once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = set()
            for text in batch.column(0).to_pylist():
                said.update(WORD.findall(text))
            yield pa.record_batch([pa.array(sorted(said), pa.string())], names=["word"])

    return texts.where(F.col("text").isNotNull()).select(F.upper("text").alias("t")).mapInArrow(collect, "word string").distinct()


def _fits(rows: DataFrame, columns: Iterable[str], limit: int = PHRASE_BYTES) -> bool:
    """Whether the texts in some columns of a table have at most ``limit`` bytes in all."""
    size = reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns])
    return (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


def _sent(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The rows, marked as a broadcast side if they are few."""
    rows = staged(rows, "entries")
    return F.broadcast(rows) if _fits(rows, columns) else rows


def _placed(dictionary: DataFrame) -> DataFrame:
    """The dictionary with a place for each trigger; one without any has its triggers in the order of their text."""
    return dictionary if "place" in dictionary.columns else dictionary.withColumn("place", F.col("trigger"))


def _finders(phrases: list[str]) -> ahocorasick.Automaton:
    """A trie with failure links over the phrases."""
    finder = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        finder.add_word(phrase, (i, len(phrase)))
    finder.make_automaton()
    return finder


def occurrences_of(text: str, finder: ahocorasick.Automaton) -> dict[int, int]:
    """How often each phrase occurs in a text: occurrences that do not overlap others of the same phrase, from the left."""
    counts: dict[int, int] = {}
    ends: dict[int, int] = {}
    for last, (i, size) in finder.iter(text):
        if last - size + 1 > ends.get(i, -1):
            counts[i] = counts.get(i, 0) + 1
            ends[i] = last
    return counts


def phrase_matches(texts: DataFrame, dictionary: DataFrame, raw: bool = False, block_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Tier 1: phrases that occur anywhere in a text, in any case.  ``raw``: the texts are taken as they are.

    The phrases are dealt into blocks of about ``block_bytes``; a block is a trie with failure links in every task, which
    walks each text once and gives all its phrases, however many there are.  Texts are not moved.
    """
    spark = texts.sparkSession
    phrases = staged(_placed(dictionary).where("tier = 1").select("trigger", "canonical", "type", "place"), "phrases")
    size = phrases.agg(F.sum(F.octet_length("trigger"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = phrases.withColumn("block", F.pmod(F.xxhash64("trigger"), F.lit(blocks)))
    upper = texts.select("item_id", F.upper(F.col("text") if raw else preprocess(F.col("text"))).alias("t")).where("t is not null")
    kind = dict(upper.dtypes)["item_id"]
    parts = []
    for block in range(blocks):
        named = dealt.where(F.col("block") == block).drop("block").withColumnRenamed("trigger", "form")
        words = [r["form"] for r in named.select("form").distinct().collect()]  # about block_bytes
        if words:
            found = upper.mapInArrow(_walker(spark.sparkContext.broadcast(words)), f"item_id {kind}, form string, reps long")
            parts.append(found.join(F.broadcast(named), "form"))  # the block again: what was found is not moved
    none = spark.createDataFrame([], f"item_id {kind}, form string, reps long").join(phrases.withColumnRenamed("trigger", "form"), "form")
    return reduce(DataFrame.unionByName, parts or [none]).select("item_id", "canonical", "type", "form", "reps", F.lit(1).alias("tier"), "place")


def _walker(shared):
    """What a task does: every text through the trie of the shared phrases."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        finder, names = _finders(words), pa.array(words, pa.string())
        for batch in batches:
            rows, forms, reps = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                counts = occurrences_of(text, finder)
                rows.extend([r] * len(counts))
                forms.extend(counts.keys())
                reps.extend(counts.values())
                if len(rows) >= BATCH_ROWS:
                    yield _taken(batch, rows, form=names.take(pa.array(forms, pa.int64())), reps=pa.array(reps, pa.int64()))
                    rows, forms, reps = [], [], []
            yield _taken(batch, rows, form=names.take(pa.array(forms, pa.int64())), reps=pa.array(reps, pa.int64()))

    return walk


def word_matches(words: DataFrame, dictionary: DataFrame, common: list[str], variants: DataFrame | None = None) -> DataFrame:
    """Tier 2: single words of a text that are triggers.  ``variants`` (variant, canonical, type) are known misreadings,
    which go before the dictionary and count although they are common words."""
    hit = words.join(_sent(_word_triggers(_placed(dictionary), common, variants), ("word", "canonical", "type")), "word")
    return hit.select("item_id", "canonical", "type", F.col("word").alias("form"), "reps", F.lit(2).alias("tier"), "place")


def _word_triggers(dictionary: DataFrame, common: list[str], variants: DataFrame | None) -> DataFrame:
    """(word, canonical, type, place) of the single words that count: known misreadings, then triggers that are not common."""
    triggers = dictionary.where("tier = 2").select(F.col("trigger").alias("word"), "canonical", "type", "place").where(~F.col("word").isin(common))
    if variants is None:
        return triggers
    known = variants.select(F.upper("variant").alias("word"), "canonical", "type", F.lit(None).cast(dictionary.schema["place"].dataType).alias("place"))
    return known.unionByName(triggers.join(known, "word", "left_anti"))


def _deletions(col: Column) -> Column:
    """The word and all its forms with one letter left out."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col))))
    return F.array_distinct(F.array_append(shorter, col))


def fuzzy_matches(words: DataFrame, dictionary: DataFrame, common: list[str], least: int = 7, taken: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """Tier 3: long words one edit away from a long trigger, of several the one that was written first.  Words that are
    triggers or known ``variants`` themselves are not misread; names that an item has by an earlier tier (``taken``:
    item_id, canonical) leave the word to the next trigger.

    Two words at most one edit apart share a form with at most one letter left out, so the pairs come from an equality
    join; the distance itself is checked after."""
    near = _near_words(words.select("word").distinct(), dictionary, common, least, variants)
    if taken is None:
        near = near.groupBy("word").agg(F.min_by(F.struct("canonical", "type", "place"), "place").alias("n"))
        hit = words.join(_sent(near, ("word", "n.canonical", "n.type")), "word")
    else:
        near = _sent(near, ("word", "trigger", "canonical", "type"))
        open_ = words.join(near, "word").join(taken.select("item_id", "canonical").distinct(), ["item_id", "canonical"], "left_anti")
        hit = open_.groupBy("item_id", "word").agg(F.min_by(F.struct("canonical", "type", "place"), "place").alias("n"), F.max("reps").alias("reps"))
    return hit.select("item_id", "n.canonical", "n.type", F.col("word").alias("form"), "reps", F.lit(3).alias("tier"), "n.place")


def _near_words(vocabulary: DataFrame, dictionary: DataFrame, common: list[str], least: int, variants: DataFrame | None) -> DataFrame:
    """(word, trigger, canonical, type, place): the long words of a vocabulary that may be misread triggers, and of which."""
    exact = dictionary.where("tier = 2").select(F.col("trigger").alias("word"))
    if variants is not None:
        exact = exact.unionByName(variants.select(F.upper("variant").alias("word")))
    asked = vocabulary.where((F.length("word") >= least) & ~F.col("word").isin(common)).join(exact, "word", "left_anti")
    triggers = _placed(dictionary).where((F.col("tier") == 3) & (F.length("trigger") >= least)).select("trigger", "canonical", "type", "place")
    left = asked.select("word", F.explode(_deletions(F.col("word"))).alias("form"))
    right = triggers.select("trigger", "canonical", "type", "place", F.explode(_deletions(F.col("trigger"))).alias("form"))
    return left.join(right, "form").select("word", "trigger", "canonical", "type", "place").distinct().where(F.levenshtein("word", "trigger", 1) == 1)


def context_matches(words: DataFrame, rules: DataFrame, least: int = 2, inside: bool = False) -> DataFrame:
    """Tier 4: ambiguous words with at least ``least`` of their context words in the same text.  ``rules``: word,
    canonical, type, context array.  ``inside``: a context word may also lie within a word of the text."""
    asked = _sent(rules.select("word", "canonical", "type", F.explode(F.array_distinct("context")).alias("other")).distinct(), ("word", "canonical", "type", "other"))
    hit = words.join(asked, "word").select("item_id", "word", "canonical", "type", "reps", "other")
    others = _sent(asked.select("other").distinct(), ("other",))
    said = words.select("item_id", F.col("word").alias("said"))
    # of a text's words only those that the rules name are moved
    near = said.join(others, F.contains("said", "other") if inside else F.col("said") == F.col("other"))
    counted = hit.join(near.select("item_id", "other").distinct(), ["item_id", "other"])
    counted = counted.groupBy("item_id", "word", "canonical", "type").agg(F.countDistinct("other").alias("n"), F.max("reps").alias("reps"))
    return counted.where(F.col("n") >= least).select("item_id", "canonical", "type", F.col("word").alias("form"), "reps", F.lit(4).alias("tier"))


def by_priority(tiers: list[DataFrame]) -> DataFrame:
    """One match per item and canonical name: the lowest tier's; of several forms there, of phrases the one that was
    written first, else the smallest."""
    order = F.when(F.col("tier") == 1, F.col("place")) if any("place" in t.columns for t in tiers) else F.lit(None)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiers)
    best = F.min(F.struct("tier", order.alias("o"), "form", "type", "reps")).alias("m")
    return every.groupBy("item_id", "canonical").agg(best).select("item_id", "canonical", "m.type", "m.form", "m.reps", "m.tier")


def scan(
    texts: DataFrame, dictionary: DataFrame, rules: DataFrame, common: list[str], fuzzy: bool = True, variants: DataFrame | None = None, raw: bool = False, inside: bool = False, block_bytes: int = ENTRY_BYTES
) -> DataFrame:
    """All tiers over the texts, each for the names that earlier ones have not found in a text.

    The names are dealt into blocks whose triggers have at most ``block_bytes``: a block's names are met with all tiers
    where an item's texts are, so that no match is moved, and each block reads the texts once.  Where those names that are
    not phrases alone have more, the dictionary is met tier by tier, which moves matches.
    """
    read = texts if raw else texts.select("item_id", preprocess(F.col("text")).alias("text"))
    dictionary = staged(_placed(dictionary), "dictionary")
    blocks = _name_blocks(dictionary, rules, common, variants, block_bytes)
    if blocks is not None:
        items, spark = _by_item(read), read.sparkSession
        schema = f"item_id {dict(read.dtypes)['item_id']}, canonical string, type string, form string, reps long, tier int"
        shared = [spark.sparkContext.broadcast((*block, sorted(common), fuzzy)) for block in blocks]
        return reduce(DataFrame.unionByName, [items.mapInArrow(_scanner(entries, inside), schema) for entries in shared])
    words = words_of(read)
    tiers = [phrase_matches(read, dictionary, True, block_bytes), word_matches(words, dictionary, common, variants)]
    if fuzzy:
        taken = reduce(DataFrame.unionByName, [t.select("item_id", "canonical") for t in tiers])
        tiers.append(fuzzy_matches(words, dictionary, common, taken=taken, variants=variants))
    return by_priority([*tiers, context_matches(words, rules, inside=inside)])


def _by_item(texts: DataFrame) -> DataFrame:
    """(item_id, texts) as ``_gathered``; where each item has one text, texts are not gathered."""
    single = single_rows(texts, "item_id")
    return _gathered(texts) if single is None else single.select("item_id", F.array_compact(F.array(F.upper("text"))).alias("texts"))


def _name_blocks(dictionary: DataFrame, rules: DataFrame, common: list[str], variants: DataFrame | None, limit: int) -> list[tuple[pa.Table, ...]] | None:
    """The entries of each block of names, in order of their precedence: phrases, words, triggers of misread words, rules.
    Names with words or rules are in the first block, so that a misread word meets all of its names there; None if they
    are too many."""
    sources = [dictionary.where("tier > 1"), rules] + ([] if variants is None else [variants])
    worded = reduce(DataFrame.unionByName, [x.select("canonical") for x in sources]).distinct().withColumn("worded", F.lit(True))
    marked = staged(dictionary.join(worded, "canonical", "left").withColumn("worded", F.coalesce("worded", F.lit(False))), "named")
    sizes = {r["worded"]: r["n"] for r in marked.groupBy("worded").agg(F.sum(F.octet_length("trigger")).alias("n")).collect()}  # two rows
    first, rest = sizes.get(True) or 0, sizes.get(False) or 0
    if first > limit:
        return None
    more = 0 if first + rest <= limit else -(-rest // limit)
    block = F.when(F.col("worded") | F.lit(more == 0), 0).otherwise(F.pmod(F.xxhash64("canonical"), F.lit(max(more, 1))) + 1)
    placed = marked.withColumn("block", block)
    order = ["place", "trigger", "type"]
    phrases = [placed.where((F.col("tier") == 1) & (F.col("block") == i)).orderBy(*order).select("trigger", "canonical", "type").toArrow() for i in range(more + 1)]  # ``limit`` each
    words = _word_triggers(dictionary, common, variants).orderBy("word", "type").select("word", "canonical", "type").toArrow()
    near = dictionary.where("tier = 3").orderBy(*order).select("trigger", "canonical", "type").toArrow()
    asked = rules.select("word", "canonical", "type", F.explode(F.array_distinct("context")).alias("other")).distinct().orderBy("word", "type", "canonical").toArrow()  # curated rules
    return [(table, *(t if i == 0 else t.slice(0, 0) for t in (words, near, asked))) for i, table in enumerate(phrases)]


def _near_forms(word: str) -> set[str]:
    """The word and all its forms with one letter left out."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and short in _near_forms(long)


def _overlapping(phrase: str) -> bool:
    """Whether two occurrences of a phrase may overlap: it ends as it begins."""
    return any(phrase.endswith(phrase[:n]) for n in range(1, len(phrase)))


class _Entries:
    """A block's entries as a task uses them.  They are numbered by precedence, so that of an item's matches for a name the
    smallest number is the one that counts; of misread words the smallest word."""

    def __init__(self, phrases: pa.Table, words: pa.Table, near: pa.Table, asked: pa.Table, common: list[str], fuzzy: bool, least: int = 7) -> None:
        self.common, self.least, self.fuzzy = set(common), least, fuzzy and len(near) > 0
        self.trie, first, self.more = ahocorasick.Automaton(ahocorasick.STORE_INTS), array("q"), defaultdict(list)
        self.overlapping: dict[int, int] = {}  # with their sizes
        for entry, form in enumerate(x.as_py() for x in phrases.column(0)):
            at = self.trie.get(form, len(first))
            if at < len(first):
                self.more[at].append(entry)
                continue
            first.append(entry)
            self.trie.add_word(form, at)
            if _overlapping(form):
                self.overlapping[at] = len(form)
        if first:
            self.trie.make_automaton()
        self.first = np.array(first, np.int64)
        self.words, self.again = {}, defaultdict(list)
        for entry, word in enumerate(words.column(0).to_pylist(), len(phrases)):
            if self.words.setdefault(word, entry) != entry:
                self.again[word].append(entry)
        start = len(phrases) + len(words)
        self.triggers = near.column(0).to_pylist()
        self.start, self.kept, self.misread = start, set(), {}
        keys, owners = array("q"), array("q")
        for i, trigger in enumerate(self.triggers if self.fuzzy else ()):
            if len(trigger) >= least:
                forms = _near_forms(trigger)
                keys.extend(map(hash, forms))
                owners.extend([i] * len(forms))
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.owners = np.array(keys, np.int64)[order], np.array(owners, np.int64)[order]
        start += len(near)
        self.contexts: dict = defaultdict(dict)
        ruled = []
        for word, canonical, kind, other in zip(*(asked.column(i).to_pylist() for i in range(4))):
            if not ruled or ruled[-1] != (word, canonical, kind):
                ruled.append((word, canonical, kind))
            self.contexts[word].setdefault(start + len(ruled) - 1, set()).add(other)
        tables = [phrases, words, near]
        column = lambda i: pa.concat_arrays([*(c for t in tables for c in t.column(i).cast(pa.string()).chunks), pa.array([r[i] for r in ruled], pa.string())])
        self.forms, self.types = column(0), column(2)
        encoded = column(1).dictionary_encode("encode")
        self.names, self.canon = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        self.tiers = np.repeat(np.array([1, 2, 3, 4], np.int32), [len(phrases), len(words), len(near), len(ruled)])

    def occurrences(self, text: str) -> Counter:
        """As ``occurrences_of``."""
        found = list(self.trie.iter(text))
        counts = Counter([i for _, i in found])
        again = {i for i in counts.keys() & self.overlapping.keys() if counts[i] > 1}
        if again:
            ends = dict.fromkeys(again, -1)
            for i in again:
                counts[i] = 0
            for last, i in found:
                if i in again and last - self.overlapping[i] + 1 > ends[i]:
                    counts[i] += 1
                    ends[i] = last
        return counts

    def look_up(self, words: set[str]) -> None:
        """Find out of which triggers words are misread, and keep it."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
            self.misread.clear()
        fresh = [w for w in words if w not in self.words and w not in self.common]
        self.kept |= words
        forms = [_near_forms(w) for w in fresh]
        keys = np.array([hash(x) for f in forms for x in f], np.int64)
        owners = np.repeat(np.arange(len(fresh)), [len(f) for f in forms])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        pairs = defaultdict(set)
        for at in np.flatnonzero(high > low):
            pairs[fresh[owners[at]]].update(self.owners[low[at] : high[at]].tolist())
        for word, near in pairs.items():
            if close := sorted(i for i in near if _one_edit(word, self.triggers[i])):
                self.misread[word] = [self.start + i for i in close]

    def matches(self, items: list[list[str]], inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(items' places, entries, repetitions, places of misread words or -1, misread words) of each item's matches."""
        rows, found, reps, spots = [], [], [], []
        counted = [_counted(texts) for texts in items] if self.words or self.fuzzy or self.contexts else []
        if self.fuzzy:
            fresh = {w for counts in counted for w in counts if len(w) >= self.least} - self.kept
            self.look_up(fresh)
        misread: list[str] = []
        phrase_rows, phrase_forms, phrase_reps = [], [], []

        def offer(row: int, entry: int, n: int, spot: int = -1) -> None:
            rows.append(row)
            found.append(entry)
            reps.append(n)
            spots.append(spot)

        for r, texts in enumerate(items):
            before, begin = len(phrase_forms), len(found)
            for text in texts if len(self.first) else ():
                counts = self.occurrences(text)
                phrase_rows.extend([r] * len(counts))
                phrase_forms.extend(counts.keys())
                phrase_reps.extend(counts.values())
                for form in counts.keys() & self.more.keys() if self.more else ():
                    for entry in self.more[form]:
                        offer(r, entry, counts[form])
            if not counted:
                continue
            counts = counted[r]
            known = list(counts.keys() & self.words.keys())
            rows.extend([r] * len(known))
            found.extend([self.words[word] for word in known])
            reps.extend([counts[word] for word in known])
            spots.extend([-1] * len(known))
            for word in counts.keys() & self.again.keys() if self.again else ():
                for entry in self.again[word]:
                    offer(r, entry, counts[word])
            wrong = counts.keys() & self.misread.keys()
            if wrong:
                entries = np.concatenate([self.first[np.array(phrase_forms[before:], np.int64)], np.array(found[begin:], np.int64)])
                taken, offered = set(self.canon[entries].tolist()), set()
                for word in sorted(wrong):
                    entry = next((e for e in self.misread[word] if self.canon[e] not in taken), None)
                    if entry is not None and self.canon[entry] not in offered:
                        offered.add(self.canon[entry])
                        offer(r, entry, counts[word], len(misread))
                        misread.append(word)
            ruled = counts.keys() & self.contexts.keys()
            said = "\n".join(counts) if inside and ruled else counts
            for word in ruled:
                for entry, others in self.contexts[word].items():
                    if sum(other in said for other in others) >= 2:
                        offer(r, entry, counts[word])
        parts = [(phrase_rows, rows), (self.first[np.array(phrase_forms, np.int64)], found), (phrase_reps, reps), (np.full(len(phrase_rows), -1), spots)]
        rows, found, reps, spots = (np.concatenate([np.array(a, np.int64), np.array(b, np.int64)]) for a, b in parts)
        keys = rows * len(self.names) + self.canon[found]
        order = np.lexsort((reps, found, keys))
        ends = np.ones(len(order), bool)
        ends[1:] = keys[order][1:] != keys[order][:-1]
        best = order[ends]
        return rows[best], found[best], reps[best], spots[best], misread


_MADE: list = [None, None]


def _entries_of(shared) -> _Entries:
    """A broadcast block's entries, made once in each worker."""
    if _MADE[0] is not shared.value:
        _MADE[:] = [None, None]
        _MADE[:] = [shared.value, _Entries(*shared.value)]
    return _MADE[1]


def _scanner(shared, inside: bool):
    """What a task does: the matches of each item's texts, one for each name, by tier, place of a phrase, form and type."""

    def scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _entries_of(shared)

        def made(ids: pa.Array, items: list[list[str]]) -> Iterator[pa.RecordBatch]:
            rows, found, reps, spots, misread = entries.matches(items, inside)
            for part, words in ((spots < 0, None), (spots >= 0, pa.array(misread, pa.string()))):
                some, at = found[part], spots[part]
                forms = entries.forms.take(pa.array(some)) if words is None else words.take(pa.array(at))
                columns = [ids.take(pa.array(rows[part])), entries.names.take(pa.array(entries.canon[some])), entries.types.take(pa.array(some)), forms, pa.array(reps[part]), pa.array(entries.tiers[some])]
                yield pa.record_batch(columns, names=["item_id", "canonical", "type", "form", "reps", "tier"])

        for batch in batches:
            ids, items, first, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
            for r, texts in enumerate(items, 1):
                size += sum(map(len, texts))
                if size >= GROUP_CHARS or r == len(items):
                    yield from made(ids.slice(first, r - first), items[first:r])
                    first, size = r, 0

    return scanner


def scan_places(texts: DataFrame, dictionary: DataFrame, rules: DataFrame, common: list[str], default: str = "region") -> DataFrame:
    """Places in the texts, taken as they are: as ``scan`` without the fuzzy tier, context words also within other words; a
    place without a type is a ``default``."""
    found = scan(texts, dictionary, rules, common, False, raw=True, inside=True)
    return found.withColumn("type", F.coalesce("type", F.lit(default)))


def unmatched(words: DataFrame, matches: DataFrame, common: list[str], limit: int = 20) -> DataFrame:
    """(item_id, candidates, n): words of four or more letters that are neither common nor part of a match, in order,
    the first ``limit`` of them, and how many there are in all."""
    used = matches.select("item_id", F.explode(F.split("form", " ")).alias("word")).distinct()
    free = words.where((F.length("word") >= 4) & ~F.col("word").isin(common)).join(used, ["item_id", "word"], "left_anti")
    rows = free.groupBy("item_id").agg(F.array_sort(F.collect_set("word")).alias("all"))
    return rows.select("item_id", F.slice("all", 1, limit).alias("candidates"), F.size("all").alias("n"))


def needs_second_pass(length: Column, matched: Column, left: Column) -> Column:
    """Texts of 50 or more characters with over 3 words left beside matches, or over 8."""
    return (length >= 50) & (((matched > 0) & (left > 3)) | (left > 8))


def repetition_report(matches: DataFrame) -> DataFrame:
    """Per lower-case name: items, repetitions, repetitions per item to one decimal, the most frequent tier."""
    tiers = matches.groupBy(F.lower("canonical").alias("key"), "tier").agg(F.count("*").alias("c"))
    primary = tiers.groupBy("key").agg(F.max_by("tier", F.struct("c", -F.col("tier"))).alias("primary_tier"))
    sums = matches.groupBy(F.lower("canonical").alias("key")).agg(F.countDistinct("item_id").alias("items"), F.sum("reps").alias("reps"))
    joined = sums.join(primary, "key")
    return joined.select(F.col("key").alias("name"), "items", "reps", F.round(F.col("reps") / F.col("items"), 1).alias("per_item"), "primary_tier")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two reports (name, total) side by side: where each name occurs, and the combined total."""
    joined = left.select("name", F.col("total").alias("left")).join(right.select("name", F.col("total").alias("right")), "name", "full_outer")
    where = F.when(F.col("right").isNull(), "left only").when(F.col("left").isNull(), "right only").otherwise("both")
    return joined.select("name", where.alias("where"), "left", "right", (F.coalesce("left", F.lit(0)) + F.coalesce("right", F.lit(0))).alias("combined"))


def tag_rows(matches: DataFrame, tagged: DataFrame) -> DataFrame:
    """(item_id, name) to add: different names of items that have no tags yet."""
    return matches.select("item_id", F.col("canonical").alias("name")).distinct().join(tagged.select("item_id").distinct(), "item_id", "left_anti")


def page_corpus(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as a corpus: the latest capture of each address, plain text, the group of equal
    texts with its first page, and whether a page is that one."""
    latest = pages.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("p")).select("url", "p.*")
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    plain = latest.select("page_id", "url", text.alias("text")).withColumn("dedup_key", F.sha2(F.lower("text"), 256))
    firsts = plain.groupBy("dedup_key").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
    return plain.join(firsts, "dedup_key").withColumn("is_first", F.col("page_id") == F.col("first_page"))
