"""Vocabulary cleaning, validation rules, and the loading of prepared answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import box_category, outer_list, split_values, strip_fences
from vitrine.operators.statistics import batches
from vitrine.operators.upsert import without_repeats


def atomic_values(value: DataFrame, mapping: DataFrame, allowed: DataFrame) -> DataFrame:
    """Composite values as several atomic ones: (item_id, value).

    ``mapping``: value, atomic (one row per part).  Values that are neither mapped nor allowed are left out.
    """
    mapped = value.join(mapping, "value").select("item_id", F.col("atomic").alias("value"))
    kept = value.join(allowed.select("value"), "value", "left_semi").select("item_id", "value")
    return mapped.unionByName(kept).distinct()


def seeded_motifs(boxes: DataFrame, mapping: DataFrame, known: DataFrame) -> DataFrame:
    """Motifs that box labels stand for and items don't have yet: (item_id, motif).  ``mapping``: category, motif."""
    named = boxes.select("item_id", box_category(F.col("value")).alias("category"))
    found = named.join(mapping, "category").select("item_id", "motif").distinct()
    return found.join(known.select("item_id", "motif"), ["item_id", "motif"], "left_anti")


def clean_vocabulary(value: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply actions to values: drop removes, canon renames, split makes several; others stay.  Of the same value twice
    at an item the smallest id stays.  ``value``: id, item_id, value; ``actions``: value, action, target array."""
    joined = value.join(actions, "value", "left")
    targets = F.when(F.col("action") == "drop", F.array().cast("array<string>")).when(F.col("action").isin("canon", "split"), F.col("target"))
    rows = joined.select("id", "item_id", F.explode(F.coalesce(targets, F.array("value"))).alias("value"))
    return without_repeats(rows, ["item_id", "value"], "id")


def action_report(value: DataFrame, actions: DataFrame) -> DataFrame:
    """(value, count, action, target): how often each value occurs and what would be done with it."""
    counts = value.groupBy("value").agg(F.count("*").alias("count"))
    joined = counts.join(actions, "value", "left")
    return joined.select("value", "count", F.coalesce("action", F.lit("keep")).alias("action"), F.coalesce(F.array_join("target", "|"), F.lit("")).alias("target"))


#: The years a date may have: fixed limits of the collection.
FIRST_YEAR, LAST_YEAR = 1989, 2024


#: Signs that say where a work is signed, and what dates and numbers must not or must look like: fixed values.
SIGNATURES = ("↖", "↑", "↗", "←", "∅", "→", "↙", "↓", "↘")
EXIF_STAMP, ISO_STAMP, BARE_NUMBER = r"^\d{4}:\d{2}:\d{2}\s+\d{2}:\d{2}:\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]", r"^\d+(\.\d+)?$"
#: Fields that may not be empty, in the order of a record's checks.
REQUIRED = ("identifier", "work_type", "support", "framing", "owner", "location", "box", "transcription")


def _value(name: str) -> Column:
    """A field without white space at its ends; null is empty."""
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _values(name: str) -> Column:
    """The values of a repeatable field that are not blank."""
    given = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.filter(given, lambda x: x != "")


def _year(date: Column) -> Column:
    return F.regexp_extract(date, r"(\d{4})", 1).try_cast("int")


def _stamp(date: Column) -> Column:
    return date.rlike(EXIF_STAMP) | date.rlike(ISO_STAMP)


def validate_items(wide: DataFrame) -> DataFrame:
    """Records with ``issues``: an array of (field, level, message), all of level error.

    Checked are the columns that the table has, of identifier, work_type, mediums, support, height, width, signature, date,
    framing, owner, location, motifs, media_count, box, transcription and category; mediums and motifs are arrays, and any
    array of texts may not repeat a value.  Values are taken without white space at their ends, null as empty.
    """
    rules: list[Column] = []

    def check(name: str, test: Column, message: str, needs: tuple[str, ...] = ()) -> None:
        if all(c in wide.columns for c in needs or (name,)):
            rules.append(F.when(test, F.struct(F.lit("media" if name == "media_count" else name).alias("field"), F.lit("error").alias("level"), F.lit(message).alias("message"))))

    def missing(*names: str) -> None:
        for name in names:
            check(name, _value(name) == "", "missing")

    date, signature = _value("date"), _value("signature")
    plain = ~_stamp(date)
    dated, signed = (date != "") & (date != "∅"), (signature != "") & (signature != "∅")
    missing("identifier", "work_type")
    check("mediums", F.size(_values("mediums")) == 0, "missing")
    missing("support")
    for name in ("height", "width"):
        missing(name)
        check(name, (_value(name) != "") & ~_value(name).rlike(BARE_NUMBER), "non-numeric")
    missing("signature")
    check("signature", (signature != "") & ~signature.isin(*SIGNATURES), "invalid")
    missing("date")
    check("date", date.rlike(EXIF_STAMP), "EXIF timestamp")
    check("date", ~date.rlike(EXIF_STAMP) & date.rlike(ISO_STAMP), "ISO timestamp")
    check("date", plain & (_year(date) < FIRST_YEAR), f"pre-{FIRST_YEAR}")
    check("date", plain & (_year(date) > LAST_YEAR), "posthumous")
    missing("framing", "owner", "location")
    check("motifs", F.size(_values("motifs")) == 0, "missing")
    check("media_count", F.coalesce(F.col("media_count"), F.lit(0)) == 0 if "media_count" in wide.columns else F.lit(False), "no image")
    missing("box", "transcription", "category")
    check("category", (_value("category") != "") & ~_value("category").isin("A", "B", "C", "D"), "invalid")
    check("date", signed & ~dated, "signed but undated", ("date", "signature"))
    check("signature", dated & ~signed, "dated but unsigned", ("date", "signature"))
    for name, kind in wide.dtypes:
        if kind == "array<string>":
            check(name, F.size(F.array_distinct(_values(name))) < F.size(_values(name)), "duplicate values")
    none = F.array().cast("array<struct<field:string,level:string,message:string>>")
    return wide.withColumn("issues", F.array_compact(F.array(*rules)) if rules else none)


def publish_ready(wide: DataFrame) -> Column:
    """Whether a record that is not public yet may be published: it has an image, a number, a type, a medium, a support, a
    height and a width that are bare numbers, a known signature, framing, an owner, and a date that is no timestamp and
    whose year, if it has one, is one of the collection's.  ``wide``: full records; without ``is_public`` none is public.
    """
    date, year = _value("date"), _year(_value("date"))
    there = [_value(name) != "" for name in ("identifier", "work_type", "support", "framing", "owner")]
    sizes = [_value(name).rlike(BARE_NUMBER) for name in ("height", "width")]
    fits = (date != "") & ~_stamp(date) & F.coalesce((year >= FIRST_YEAR) & (year <= LAST_YEAR), F.lit(True))
    new = ~F.coalesce(F.col("is_public").cast("boolean"), F.lit(False)) if "is_public" in wide.columns else F.lit(True)
    rest = [new, F.coalesce(F.col("media_count"), F.lit(0)) > 0, F.size(_values("mediums")) > 0, _value("signature").isin(*SIGNATURES), fits]
    return reduce(Column.__and__, there + sizes + rest)


def publish_warnings(wide: DataFrame) -> Column:
    """What a record that can be published still lacks: an array of fields, of those that its table has."""
    none = [F.when(F.size(_values("motifs")) == 0, "motifs")] if "motifs" in wide.columns else []
    none += [F.when(_value(name) == "", name) for name in ("transcription", "category", "box", "condition", "location") if name in wide.columns]
    return F.array_compact(F.array(*none).cast("array<string>"))


def bad_date(date: Column, signature: Column) -> Column:
    """Whether a date is missing, unknown although the work is signed, a timestamp, or outside the years of the
    collection."""
    year = F.regexp_extract(date, r"(\d{4})", 1).try_cast("int")
    stamp = date.rlike(r"^\d{4}:\d{2}:\d{2}\s+\d{2}:\d{2}:\d{2}$") | date.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    signed = F.coalesce((signature != "") & (signature != "∅"), F.lit(False))
    return F.when(F.coalesce(date, F.lit("")) == "", True).when(date == "∅", signed).otherwise(stamp | F.coalesce((year < FIRST_YEAR) | (year > LAST_YEAR), F.lit(False)))


def sprint_predicates(wide: DataFrame) -> DataFrame:
    """(id, sixteen booleans): for each field of full records whether a clean-up sprint would offer the record.

    ``wide``: id, identifier, date, work_type, support, condition, signature, motifs, transcription, mediums, height,
    width, framing, owner, location, box, category, media_count.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    number = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"^\d+(\.\d+)?$")
    dated = ~blank("date") & (F.col("date") != "∅")
    signature = blank("signature") | ~F.col("signature").isin(*SIGNATURES) | (dated & (F.col("signature") == "∅"))
    found = {name: blank(name) for name in ("identifier", "work_type", "support", "condition", "transcription", "framing", "owner", "location", "box")}
    found |= {"date": bad_date(F.col("date"), F.col("signature")), "signature": signature, "motifs": F.coalesce(F.size("motifs"), F.lit(0)) < 2}
    found |= {"mediums": F.coalesce(F.size("mediums"), F.lit(0)) <= 0, "dimensions": ~number("height") | ~number("width")}
    found |= {"category": blank("category") | ~F.col("category").isin("A", "B", "C", "D"), "media": F.coalesce("media_count", F.lit(0)) == 0}
    return wide.select("id", *[test.alias(f"fix_{name}") for name, test in found.items()])


def issue_queue(validated: DataFrame) -> DataFrame:
    """Items with errors, the most issues first."""
    errors = F.filter("issues", lambda x: x["level"] == "error")
    return validated.where(F.size(errors) > 0).select("id", F.size("issues").alias("n"), F.size(errors).alias("errors")).orderBy(F.desc("n"), "id")


def transition_violations(df: DataFrame) -> DataFrame:
    """Rule breaks of submissions (status, item_id, reason)."""
    known = F.col("status").isin("new", "accepted", "rejected")
    violation = F.when(~known | F.col("status").isNull(), "unknown status")
    violation = violation.when((F.col("status") == "accepted") & F.col("item_id").isNull(), "accepted without item")
    violation = violation.when((F.col("status") == "rejected") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "rejected without reason")
    return df.withColumn("violation", violation)


REFERENCE = "array<struct<reference_name string, reference_type string, text_excerpt string>>"


def validated_references(answers: DataFrame, types: list[str]) -> DataFrame:
    """References out of answers (item_id, answer): the outermost list, entries with a name and a known type, excerpts
    of at most 150 characters.  An answer that isn't such a list has none."""
    parsed = F.from_json(outer_list(strip_fences(F.col("answer"))), REFERENCE)
    good = F.filter(parsed, lambda r: (F.trim(r["reference_name"]) != "") & r["reference_type"].isin(types))
    rows = answers.select("item_id", F.explode(good).alias("r"))
    short = F.when(F.length("r.text_excerpt") > 150, F.concat(F.substring("r.text_excerpt", 1, 147), F.lit("..."))).otherwise(F.col("r.text_excerpt"))
    return rows.select("item_id", F.trim("r.reference_name").alias("name"), F.col("r.reference_type").alias("type"), short.alias("excerpt"))


def coerced(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values as the vocabulary spells them; values it doesn't know are left out."""
    spelled = vocabulary.groupBy(F.lower("value").alias("key")).agg(F.min("value").alias("spelled"))
    joined = rows.withColumn("key", F.lower(F.trim("value"))).join(spelled, "key")
    exact = vocabulary.select(F.col("value").alias("exact")).distinct()
    both = joined.join(exact, F.trim(joined["value"]) == F.col("exact"), "left")
    return both.select(*[c for c in rows.columns if c != "value"], F.coalesce("exact", "spelled").alias("value"))


def coerced_lists(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values as the vocabulary spells them, as ``coerced``; a value that is a JSON list and no term keeps the members that
    are terms, again as JSON; other values are left out.  ``rows`` need an id that tells them apart."""
    terms = vocabulary.select("value").distinct()
    single = coerced(rows, vocabulary)
    listed = F.from_json("value", "array<string>")
    several = rows.where(F.ltrim("value").startswith("[")).where(listed.isNotNull()).join(single.select("id"), "id", "left_anti")
    parts = several.select("id", F.posexplode(listed).alias("pos", "part")).join(terms.withColumnRenamed("value", "part"), "part", "left_semi")
    kept = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    made = F.to_json(F.coalesce(F.transform("p", lambda x: x["part"]), F.array().cast("array<string>")))
    others = several.join(kept, "id", "left").select(*[c for c in rows.columns if c != "value"], made.alias("value"))
    return single.unionByName(others.select(*single.columns))


def removed_values(value: DataFrame, actions: DataFrame) -> DataFrame:
    """The rows that ``clean_vocabulary`` takes away or changes, with the action: the backup of a cleaning."""
    return value.join(actions.where(F.col("action").isin("drop", "canon", "split")).select("value", "action"), "value").select(*value.columns, "action")


def _first(rows: DataFrame, value: str) -> DataFrame:
    """(item_id, value): of each item's rows the first by ``pos``, or the least value where rows have no place."""
    order = "pos" if "pos" in rows.columns else value
    return rows.groupBy("item_id").agg(F.min_by(value, order).alias(value))


def _judged(subjects: DataFrame, actions: DataFrame, boxes: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subjects with what becomes of them: seeded, drop, nonvisual, canon, split; each item's box category with its seed and
    prior)."""
    folded = actions.groupBy(F.lower("value").alias("key")).agg(F.min(F.struct("value", "action", "target")).alias("a"))
    folded = folded.select("key", F.col("a.action").alias("any_action"), F.col("a.target").alias("any_target"))
    boxed = _first(boxes.withColumn("category", box_category(F.col("value"))).where("category != ''"), "category").join(seeds, "category", "left")
    read = subjects.withColumn("key", F.lower("value")).join(actions, "value", "left").join(folded, "key", "left").join(boxed.select("item_id", "seed"), "item_id", "left")
    exact = F.col("action").isNotNull()
    action, target = F.coalesce("action", "any_action"), F.when(exact, F.col("target")).otherwise(F.col("any_target"))
    became = F.when(action.isNotNull() & (F.col("seed") == F.col("value")), "seeded").otherwise(action)
    return read.select("item_id", "value", became.alias("action"), target.alias("target")), boxed


def ground_truth(items: DataFrame, subjects: DataFrame, actions: DataFrame, boxes: DataFrame, seeds: DataFrame, dates: DataFrame, last_early: int) -> DataFrame:
    """(item_id, genuine, box_prior, year, early): what is known of every item, as a training set.

    ``subjects``: item_id, value; ``actions``: value, action (canon, split, drop, nonvisual), target array, met exactly or
    else in any case; ``boxes``: item_id, value; ``seeds``: category, seed, prior, the motif that a box once put on its
    items, which then doesn't count as genuine, and what its items tend to show; ``dates``: item_id, year; items up to
    ``last_early`` are early.  Of several boxes or years that can be read the first by ``pos`` counts, where boxes and
    dates have that column.
    """
    judged, boxed = _judged(subjects, actions, boxes, seeds)
    real = judged.where(F.col("action").isin("canon", "split"))
    genuine = real.select("item_id", F.explode("target").alias("motif")).groupBy("item_id").agg(F.array_sort(F.collect_set("motif")).alias("genuine"))
    years = _first(dates.where("year is not null and year != 0"), "year")
    joined = items.select("item_id").distinct().join(genuine, "item_id", "left").join(boxed.select("item_id", "prior"), "item_id", "left").join(years, "item_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("item_id", F.coalesce("genuine", none).alias("genuine"), F.col("prior").alias("box_prior"), "year", (F.col("item_id") <= last_early).alias("early"))


def ground_truth_counters(subjects: DataFrame, actions: DataFrame, boxes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(counter, n) of ``ground_truth``: rows that a box put there, that are dropped and that show nothing, and for each
    ``motif:name`` the items that genuinely have it."""
    judged, _ = _judged(subjects, actions, boxes, seeds)
    names = F.create_map(*[F.lit(x) for x in ("seeded", "box_derived_rows", "drop", "junk_rows", "nonvisual", "nonvisual_rows")])
    rows = judged.where(F.col("action").isin("seeded", "drop", "nonvisual")).groupBy("action").agg(F.count("*").alias("n")).select(F.element_at(names, F.col("action")).alias("counter"), "n")
    motifs = judged.where(F.col("action").isin("canon", "split")).select("item_id", F.explode("target").alias("m")).distinct()
    return rows.unionByName(motifs.groupBy(F.concat(F.lit("motif:"), F.col("m")).alias("counter")).agg(F.count("*").alias("n")))


def enrichment_values(results: DataFrame, present: DataFrame, force: bool = False, default: str = "") -> DataFrame:
    """Values to store out of results (item_id, status, answer): failed ones give none, an empty answer the default;
    several values in one answer become several rows; items in ``present`` keep theirs unless forced."""
    answer = strip_fences(F.col("answer"))
    text = F.when(answer == "", F.lit(default)).otherwise(answer)
    rows = results.where(F.col("status") == "succeeded").select("item_id", F.explode(split_values(text)).alias("value"))
    rows = rows.where(F.col("value") != "") if default == "" else rows
    return rows if force else rows.join(present.select("item_id").distinct(), "item_id", "left_anti")


def split_submissions(submissions: DataFrame, per_file: bool = True) -> DataFrame:
    """Submissions (id, files array) as items: one per file with its position, or one each."""
    if per_file:
        return submissions.select("id", F.posexplode("files").alias("position", "file"))
    return submissions.select("id", F.lit(0).alias("position"), F.get("files", F.lit(0)).alias("file"))


LOCATIONS = "array<struct<location_name string, location_type string, coordinates array<double>, narrative_role string, flags array<string>>>"


def validated_locations(answers: DataFrame, types: list[str], roles: list[str], flags: list[str]) -> DataFrame:
    """Places out of answers (item_id, answer): entries with a name, a known type and role; coordinates only as two
    numbers, flags only known ones."""
    parsed = F.from_json(outer_list(strip_fences(F.col("answer"))), LOCATIONS)
    good = F.filter(parsed, lambda r: (F.trim(r["location_name"]) != "") & r["location_type"].isin(types) & r["narrative_role"].isin(roles))
    rows = answers.select("item_id", F.explode(good).alias("r"))
    known = F.array(*[F.lit(f) for f in flags]).cast("array<string>")
    pair = F.when((F.size("r.coordinates") == 2) & F.forall("r.coordinates", lambda x: x.isNotNull()), F.col("r.coordinates"))
    return rows.select(
        "item_id", F.trim("r.location_name").alias("name"), F.col("r.location_type").alias("type"), F.col("r.narrative_role").alias("role"),
        pair.alias("coordinates"), F.coalesce(F.array_intersect("r.flags", known), F.array().cast("array<string>")).alias("flags"),
    )


def backfilled_dates(credits: DataFrame, dated: DataFrame) -> DataFrame:
    """(item_id, date) to insert: the first ISO date of a credit text, for items without a date."""
    found = credits.select("item_id", F.regexp_extract("credit", r"(\d{4}-\d{2}-\d{2})", 1).alias("date")).where("date != ''")
    return found.groupBy("item_id").agg(F.min("date").alias("date")).join(dated.select("item_id").distinct(), "item_id", "left_anti")


def curated(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Members of a set after decisions (id, keep, outlet): dropped where keep is false, with the outlet where given;
    decided items that are kept and weren't members join."""
    kept = decisions.where("keep").select("id", "outlet")
    undecided = members.join(decisions.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("outlet"))
    return undecided.unionByName(kept)


def reconciled(rows: DataFrame) -> DataFrame:
    """What to do for reconciled rows (url, action, matched_id): insert, link or nothing, and to which item."""
    step = F.when(F.col("action") == "create", "insert").when((F.col("action") == "add_existing") & F.col("matched_id").isNotNull(), "link").otherwise("none")
    return rows.select("url", step.alias("step"), F.when(step == "link", F.col("matched_id")).alias("target"))


def enrichment_requests(items: DataFrame, cached: DataFrame, size: int = 500) -> DataFrame:
    """Items with text that aren't cached, in batches of ``size`` by id: (item_id, text, batch)."""
    waiting = items.where(F.trim("text") != "").join(cached.select("item_id").distinct(), "item_id", "left_anti")
    return batches(waiting, "item_id", size)


def sprint_flags(wide: DataFrame) -> DataFrame:
    """One boolean column per field that a clean-up sprint would offer: (id, no_date, bad_date, no_size, no_motif,
    repeated_motif, no_category)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return wide.select(
        "id",
        blank("date").alias("no_date"),
        (~blank("date") & ~F.col("date").rlike(r"^(c\. )?\d{4}$|^∅$|^undated$")).alias("bad_date"),
        (blank("height") | blank("width")).alias("no_size"),
        (F.size("motifs") == 0).alias("no_motif"),
        (F.size(F.array_distinct("motifs")) < F.size("motifs")).alias("repeated_motif"),
        blank("category").alias("no_category"),
    )
