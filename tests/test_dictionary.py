"""Dictionaries by order of precedence, phrases by a trie, scans against a plain version of the tiers."""

import collections
import random
import re

import pytest
from vitrine.functions.text import preprocess
from vitrine.operators import dictionary, extraction

PRIOR = "pos int, canonical string, type string, mention string"
MORE = "pos int, canonical string, type string, singles array<string>, multis array<string>"


def triggers(spark, prior, more=None, **how):
    found = dictionary.build(spark.createDataFrame(prior, PRIOR), spark.createDataFrame(more, MORE) if more else None, **how)
    return {(r["tier"], r["trigger"]): (r["canonical"], r["type"]) for r in found.collect()}


def test_later_names_take_triggers_and_supplementary_ones_only_free_ones(spark):
    prior = [
        (1, "Pablo Picasso", "artist", "Pablo"), (2, "Bo", "dog", None), (3, "Paloma Picasso", "designer", "the lady with the doves"), (4, "Pablo Picasso", "other", "the old master"),
        (5, "Max King", "actor", "Kid"), (6, "Lily", "flower", "ox"),
    ]
    more = [(1, "Bo", "cat", ["bobo", "picasso"], ["Max King", "Bo the Dog"]), (2, "Bobo Doll", "toy", ["bobo"], []), (3, "Pablo Picasso", "x", ["Ruiz"], [])]
    found = triggers(spark, prior, more, ambiguous=("KING",), common=("LILY",))
    assert found == {
        (1, "PABLO PICASSO"): ("Pablo Picasso", "artist"), (2, "PICASSO"): ("Paloma Picasso", "designer"), (3, "PICASSO"): ("Paloma Picasso", "designer"),
        (2, "PABLO"): ("Pablo Picasso", "artist"), (2, "BO"): ("Bo", "dog"), (3, "BO"): ("Bo", "dog"), (1, "PALOMA PICASSO"): ("Paloma Picasso", "designer"),
        (1, "THE OLD MASTER"): ("Pablo Picasso", "artist"), (1, "MAX KING"): ("Max King", "actor"), (2, "LILY"): ("Lily", "flower"),
        (2, "BOBO"): ("Bo", "dog"), (3, "BOBO"): ("Bo", "dog"), (1, "BO THE DOG"): ("Bo", "dog"), (1, "BOBO DOLL"): ("Bobo Doll", "toy"),
        (2, "RUIZ"): ("Pablo Picasso", "artist"), (3, "RUIZ"): ("Pablo Picasso", "artist"),
    }


def test_places_have_no_last_words_or_mentions(spark):
    found = triggers(spark, [(1, "New York", "city", "Gotham"), (2, "Ur", "city", None), (3, "Rom", "city", None), (4, "Nice", "city", None)], ambiguous=("NICE",), last_words=False, least=3)
    assert set(found) == {(1, "NEW YORK"), (2, "ROM")}


def test_misreadings_go_to_what_their_trigger_means(spark):
    known = dictionary.build(spark.createDataFrame([(1, "Jan Vermeer", "artist", "Ver Meer")], PRIOR))
    given = spark.createDataFrame([("VERMER", "Vermeer"), ("vermeir", "ver meer"), ("x", "unknown"), ("VERMEER", "vermeer")], "variant string, trigger string")
    assert {tuple(r) for r in dictionary.resolved(given, known).collect()} == {("VERMER", "Jan Vermeer", "artist"), ("VERMEIR", "Jan Vermeer", "artist")}


def test_broken_words_are_rejoined(spark):
    df = spark.createDataFrame([("RAUSCH-\nENBERG  and\r\n a- b self- made\n",), (None,)], "t string")
    assert [r[0] for r in df.select(preprocess(df.t)).collect()] == ["RAUSCHENBERG and a- b selfmade", None]


@pytest.mark.parametrize("block_bytes", [1 << 23, 60])
def test_every_phrase_of_a_text_is_counted(spark, block_bytes):
    rng = random.Random(6)
    words = ["aa", "b", "cc", "ddd"]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))).upper() for _ in range(40)})
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(50)] + [(90, None), (91, ""), (5, "aa b aa b aa")]
    names = spark.createDataFrame([(p, "t") for p in phrases], "canonical string, type string")
    found = extraction.phrase_matches(spark.createDataFrame(texts, "item_id int, text string"), extraction.build_dictionary(names, []), block_bytes=block_bytes).collect()
    want = collections.Counter((i, p, len(re.findall(re.escape(p), (t or "").upper()))) for i, t in texts for p in phrases if p in (t or "").upper())
    assert collections.Counter((r["item_id"], r["form"], r["reps"]) for r in found) == want
    empty = extraction.phrase_matches(spark.createDataFrame(texts, "item_id int, text string"), extraction.build_dictionary(names.limit(0), []))
    assert empty.count() == 0


def test_tiers_follow_each_other(spark):
    prior = [(1, "Anna Feldmann", "artist", None), (2, "Otto Feldman", "artist", None), (3, "Bird", "animal", None), (4, "Karl Grossman", "artist", "Karl of Ulm")]
    known = dictionary.build(spark.createDataFrame(prior, PRIOR), ambiguous=("BIRD",))
    rules = spark.createDataFrame([("BIRD", "Charlie Parker", "musician", ["JAZZ", "SAX", "MONK"])], "word string, canonical string, type string, context array<string>")
    texts = [(1, "anna feldmann met FELDMANN; a bird, no JAZZ"), (2, "Jazz by bird and monk"), (3, "Grossmann, GROSSMANN and feldmanx"), (4, "karl of ulm: Karl Grossman"), (5, "saxophone jazzy bird")]
    df = spark.createDataFrame(texts, "item_id int, text string")
    found = {(r["item_id"], r["canonical"]): (r["form"], r["reps"], r["tier"]) for r in extraction.scan(df, known, rules, ["KARL"]).collect()}
    assert found == {
        (1, "Anna Feldmann"): ("ANNA FELDMANN", 1, 1), (2, "Charlie Parker"): ("BIRD", 1, 4), (3, "Karl Grossman"): ("GROSSMANN", 2, 3),
        (3, "Anna Feldmann"): ("FELDMANX", 1, 3), (4, "Karl Grossman"): ("KARL GROSSMAN", 1, 1),
    }
    places = {(r["item_id"], r["canonical"]) for r in extraction.scan_places(df, known, rules, []).collect()}
    assert (5, "Charlie Parker") in places and (2, "Charlie Parker") in places and (1, "Charlie Parker") not in places


def _moved(spark, make):
    """The plan's shuffles that carry words."""
    plan = make()._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("word" in line or "canonical" in line or "form" in line)]


def test_a_scan_in_one_pass_gives_what_the_tiers_give_one_by_one(spark):
    texts = [(1, "The RED HOUSE and the red house, painters"), (1, "und die Painterz der the of"), (2, None), (3, "PAINTERS pointers of the and"), (4, ""), (None, "red house")]
    df = spark.createDataFrame(texts, "item_id int, text string")
    names = spark.createDataFrame([("red house", "t"), ("painters", None), ("big pointers", "p")], "canonical string, type string")
    rules = spark.createDataFrame([("THE", "The", "k", ["AND", "OF"]), ("DIE", "Die", "k", ["UND", "DER", "NE"])], "word string, canonical string, type string, context array<string>")
    known = extraction.build_dictionary(names, [])
    for more in ({}, {"fuzzy": False, "raw": True, "inside": True}):
        one, several = (sorted(map(repr, extraction.scan(df, known, rules, ["OF"], block_bytes=n, **more).where("item_id is not null").collect())) for n in (1 << 20, 8))
        assert one == several and len(one) > 5
    assert not _moved(spark, lambda: extraction.scan(df, known, rules, ["OF"]))


def test_words_and_their_matches_are_not_moved(spark):
    df = spark.createDataFrame([(1, "red red house"), (1, "Red"), (2, None)], "item_id int, text string")
    words = extraction.words_of(df)
    assert sorted(map(tuple, words.collect())) == [(1, "HOUSE", 1), (1, "RED", 3)]
    known = extraction.build_dictionary(spark.createDataFrame([("red", "t"), ("red house", "t")], "canonical string, type string"), [])
    assert not _moved(spark, lambda: words)
    assert not _moved(spark, lambda: extraction.word_matches(words, known, []))
    assert not _moved(spark, lambda: extraction.phrase_matches(df, known))


def test_names_in_several_blocks_are_found_without_moving_matches(spark):
    """a dictionary above the limit is met block by block of names, not tier by tier."""
    texts = [(1, "An ox ox ox and the red ox, painterz"), (2, "red ox big ox OLD OX ox ox"), (3, "Painters paint the and of"), (4, None), (5, "painterx of the big ox")]
    df = spark.createDataFrame(texts, "item_id int, text string")
    names = spark.createDataFrame([("red ox", "t"), ("big ox", None), ("old ox", "t"), ("ox ox", "t"), ("painters", "p")], "canonical string, type string")
    rules = spark.createDataFrame([("THE", "The", "k", ["AND", "OF"])], "word string, canonical string, type string, context array<string>")
    known = extraction.build_dictionary(names, [])
    found = extraction.scan(df, known, rules, [], block_bytes=20)  # 24 bytes of phrases alone, 16 of words
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") > 1
    assert not _moved(spark, lambda: found)
    rows = sorted((r["item_id"], r["canonical"], r["type"], r["form"], r["reps"], r["tier"]) for r in found.where("canonical != 'big ox'").collect())
    assert rows == [
        (1, "ox ox", "t", "OX OX", 1, 1), (1, "painters", "p", "PAINTERZ", 1, 3), (1, "red ox", "t", "RED OX", 1, 1), (2, "old ox", "t", "OLD OX", 1, 1), (2, "ox ox", "t", "OX OX", 1, 1),
        (2, "red ox", "t", "RED OX", 1, 1), (3, "The", "k", "THE", 1, 4), (3, "painters", "p", "PAINTERS", 1, 2), (5, "painters", "p", "PAINTERX", 1, 3),
    ]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, extraction.scan(df, known, rules, []).collect()))
