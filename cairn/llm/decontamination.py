"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names become typed placeholders. Runs of five template words are hashed;
runs of documents pass a bitmap of fixed size made from the benchmark's, and those that pass meet the
benchmark's by a hash join. An item leaks into a document when enough of its runs occur there and the
values in the placeholders are consistent, at one place or in the document as a whole."""

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import BITS, bitmap, dealt_join, grouped, save, session, slices, table, utf8, window_hashes, word_hashes, words

#: Words in a run; share of an item's runs and of its placeholders' values that must agree; words of a run that are no placeholders.
WIDTH, SHARE, CONSISTENT, PLAIN = 5, 0.8, 0.8, 2
#: Share of values that must tell the item's apart: lower, as two slots may well get one value by chance.
DISTINCT = 0.5
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|mile|miles|ft|feet|inch|inches|l|ml|litres|liters|h|hr|hrs|hour|hours|min|mins|minute|minutes|s|sec|seconds|day|days|week|weeks|month|months|year|years|km/h|mph|dollars|cents|euros|pounds|eur|usd"
#: A number with its unit (groups 1 and 2, what follows the first digit), a name within a sentence (3), another capitalised word (4). The first character is tried by itself, as searching for that is fast.
_SLOT = re.compile(rf"[\dA-ZÀ-Þ](?:(?<=\d)(\d*(?:[.,:/]\d+)*)(?:\s?(%|\$|€|£|°|(?:{UNITS})\b))?|(?<=[A-ZÀ-Þ])(?:(?<=[a-zß-ÿ,] .)([a-zß-ÿ]+)\b|(?<=\b.)([a-zß-ÿ]+)\b))")
_LOWER = re.compile(r"\b[a-zß-ÿ]+\b")
#: Words that are no names where they begin a sentence, whatever the benchmark holds.
_PLAIN_WORDS = frozenset(
    "an and are as at but by can could did do does each every find for from given had has have he her his how if in into is it its let my of on one or our she should so some that the their them then there these they this those to was we were what when where which who whom whose why will with would you your "
    "als aus bei das dem den der des die ein eine er es für im in ist mit sie und von wann warum was welche wenn wer wie wieviel wir wo zu "
    "au aux avec ce ces cette comment dans de des du elle elles en est et il ils la le les on où par pour pourquoi quand que quel quelle qui si sur un une "
    "al con cuando cuánto cuántos cómo del donde dónde el ella en es esta este la las lo los para por qué quién se si su un una y".split()
)
_MARKS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„–—…€£°"})


def _slot_of(word: str) -> int:
    return zlib.crc32(word.encode()) >> (32 - BITS)


def template(text: str, common: bytes | None = None) -> tuple[str, list[str], list[str]]:
    """Lower-cased words of the text with placeholders 1 (number), 2 (unit) and 3 (name), and the values these hold in order.

    A capitalised word that begins a sentence is marked by \\x02 if it can be a name (no common word); the
    second list of values holds these words, too."""
    values: list[str] = []
    wide: list[str] = []

    def slot(m) -> str:
        if m[4]:
            word = m[0].lower()
            if word in _PLAIN_WORDS or common is not None and common[(at := _slot_of(word)) >> 3] >> (at & 7) & 1:
                return m[0]
            wide.append(word)
            return "\x02" + m[0]
        if m[3]:
            values.append(m[0].lower())
            wide.append(values[-1])
            return " \x01n "
        number = m[0][0] + m[1]
        own = [number, m[2].lower()] if m[2] else [number]
        values.extend(own)
        wide.extend(own)
        return " \x01d \x01u " if m[2] else " \x01d "

    return _SLOT.sub(slot, text.replace("\x01", " ").replace("\x02", " ")).translate(_MARKS).lower(), values, wide


def _words_seen(batches):
    """Of a partition's items: words in small letters, and names within a sentence, by their slot in the bitmap of common words."""
    for batch in batches:
        seen: dict[int, list[bool]] = {}
        for text in batch.column("text").to_pylist():
            for word in _LOWER.findall(text or ""):
                seen.setdefault(_slot_of(word), [False, False])[0] = True
            for m in _SLOT.finditer(text or ""):
                if m[3]:
                    seen.setdefault(_slot_of(m[0].lower()), [False, False])[1] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([x for x, _ in seen.values()], pa.bool_()), pa.array([x for _, x in seen.values()], pa.bool_())], ["slot", "small", "name"])


_NAME = word_hashes(np.frombuffer(b"\x01n", np.uint8), np.array([0]), np.array([2]))[0]


def _forms(texts: list[str | None], widths: list[int], common: bytes | None):
    """For each width and each form of a list of texts (0: as template() gives them, 1: with marked words as names):
    form, width, and of each run its text, place, hash, first value, number of placeholders and whether it holds a marked word; the values."""
    made = [template(x or "", common) for x in texts]
    raw, off = utf8(pa.array([t for t, _, _ in made], pa.string()))
    starts, ends, first = words(raw, off)
    marked = raw[starts] == 2
    plain = word_hashes(raw, starts + marked, ends)
    slots = raw[starts] == 1
    new = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(marked, out=new[1:])
    for width in widths:
        for form, hashed, placeholders in ((0, plain, slots), (1, np.where(marked, _NAME, plain), slots | marked)):
            hashes, at = window_hashes(hashed, first, width)
            of = np.repeat(np.arange(len(texts)), np.diff(at))
            place = np.arange(len(hashes)) - at[of]
            held = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(placeholders, out=held[1:])
            here = first[of] + place
            before = held[here]
            yield form, width, of, place, hashes, before - held[first[of]], held[here + width] - before, new[here + width] > new[here], [m[1 + form] for m in made]


def _literal_words(text: str) -> str:
    return text.translate(_MARKS).lower()


_LITERAL = np.uint64(0x5851F42D4C957F2D)


def _literal(texts: list[str | None], widths: list[int]):
    """As _forms, of the texts' words as they stand, in form 2; their hashes meet no other form's."""
    raw, off = utf8(pa.array([_literal_words(x or "") for x in texts], pa.string()))
    starts, ends, first = words(raw, off)
    hashed = word_hashes(raw, starts, ends)
    for width in widths:
        hashes, at = window_hashes(hashed, first, width)
        of = np.repeat(np.arange(len(texts)), np.diff(at))
        none = np.zeros(len(hashes), np.int64)
        yield 2, width, of, np.arange(len(hashes)) - at[of], hashes ^ _LITERAL, none, none, none == 1, [[]] * len(texts)


_ROWS = "id {0}, own long, form int, place int, hash long, slot int, slots array<string>"


def _windows(bits: np.ndarray | None, common: bytes | None, widths: list[int], literal: list[int]):
    """Runs of texts; of an item, form 1 is whole if a word is marked in it, of a document, what it has beside form 0."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for form, width, of, place, hashes, skip, n, marked, values in chain(_forms(texts, widths, common) if widths else (), _literal(texts, literal) if literal else ()):
                    keep = n <= width - min(PLAIN, width)
                    if bits is not None:
                        slot = hashes >> np.uint64(64 - BITS)
                        keep &= bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
                    if form == 1:
                        keep &= marked if bits is not None else np.isin(of, of[marked])
                    rows = np.flatnonzero(keep)
                    slots = [values[of[r]][skip[r] : skip[r] + n[r]] for r in rows]
                    text = pa.array(of[rows])
                    forms = pa.array(np.full(len(rows), form, np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(text), part.column("own").take(text), forms, pa.array(place[rows], pa.int32()), pa.array(hashes[rows].view(np.int64)), pa.array(skip[rows], pa.int32()), pa.array(slots, pa.list_(pa.string()))], ["id", "own", "form", "place", "hash", "slot", "slots"])

    return run


def _agreement(pairs) -> float:
    """The share of (key, value) pairs that follow the most frequent value of their key; 1 without pairs."""
    by: dict = {}
    for key, value in pairs:
        seen = by.setdefault(key, {})
        seen[value] = seen.get(value, 0) + 1
    n = sum(sum(seen.values()) for seen in by.values())
    return sum(max(seen.values()) for seen in by.values()) / n if n else 1.0


def occurrences(places: list[int], item_places: list[int], reach: int) -> list[list[int]]:
    """Rows (a run's place in a text, its place in the item; in order of these) as occurrences of the item.

    An occurrence runs forward in both. A row goes on with the occurrence whose last row it follows at the
    nearest distance in the item as in the text, at most `reach` words after it in the text, or begins one."""
    done: list[list[int]] = []
    live: list[list[int]] = []
    at = 0
    while at < len(places):
        to = at
        while to < len(places) and places[to] == places[at]:
            to += 1
        here = places[at]
        kept = []
        for rows in live:
            (kept if here - places[rows[-1]] <= reach else done).append(rows)
        live = kept
        fits = []
        for row in range(at, to):
            for k, rows in enumerate(live):
                ahead = item_places[row] - item_places[rows[-1]]
                if ahead > 0:
                    fits.append((abs(here - places[rows[-1]] - ahead), -k, row))
        placed, grown = set(), set()
        for _, k, row in sorted(fits):
            if row not in placed and k not in grown:
                placed.add(row)
                grown.add(k)
                live[-k].append(row)
        live += [[row] for row in range(at, to) if row not in placed]
        at = to
    return done + live


def _judged(batches):
    """Of each document and item: the best occurrence, or the document as a whole, that reaches SHARE and is consistent."""
    for _, t in grouped(batches, ["pair"]):
        own, place, item_place = (t.column(c).to_pylist() for c in ("own", "place", "item_place"))
        hashes, slots, item_slots = (t.column(c).to_pylist() for c in ("hash", "slots", "item_slots"))
        n_runs, item_slot = t.column("n_runs")[0].as_py(), t.column("item_slot").to_pylist()
        reach = max(item_place) + 2 * WIDTH
        best = None
        kinds = [(range(t.num_rows), False)]
        starts = [0, *(i for i in range(1, t.num_rows) if own[i] != own[i - 1]), t.num_rows]
        for at, to in zip(starts, starts[1:]):
            kinds += [([at + r for r in rows], True) for rows in occurrences(place[at:to], item_place[at:to], reach)]
        for rows, by_slot in kinds:
            found = len({hashes[r] for r in rows})
            if found < n_runs * SHARE:
                continue
            pairs = [(item_slot[r] + j, given, value) for r in rows for j, (given, value) in enumerate(zip(item_slots[r], slots[r]))]
            agree = _agreement((slot if by_slot else given, value) for slot, given, value in pairs)
            apart = _agreement((value, given) for _, given, value in (set(pairs) if by_slot else pairs))
            if agree >= CONSISTENT and apart >= DISTINCT and (best is None or (found, agree) > best):
                best = (found, agree)
        if best:
            yield pa.RecordBatch.from_arrays([t.column("id").slice(0, 1).combine_chunks(), t.column("item").slice(0, 1).combine_chunks(), pa.array([n_runs], pa.int64()), pa.array([best[0]], pa.int64()), pa.array([best[0] / n_runs]), pa.array([best[1]])], ["id", "item", "n_runs", "n_found", "containment", "consistency"])


def _sizes(counted):
    def run(batches):
        for batch in batches:
            n = [len(counted(x or "").split()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), batch.column("text"), pa.array(n, pa.int32())], ["id", "own", "text", "n"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_runs, n_found, containment, consistency): one row for each document and item that leaks into it.

    An item leaks if an occurrence of it (its runs in their order, near each other), or the document as a
    whole, holds SHARE of its distinct template runs (containment) with consistent values: in an
    occurrence, the share of values that follow the most frequent counterpart of each slot of the item, in
    the whole document, of each value of the item (1 without placeholders), is CONSISTENT or more, and the
    other way round, of each value of the document, DISTINCT or more, so that a text that fills all slots
    with one value is none. Placeholders meet only their own kind. The figures are of the one
    with most runs. A capitalised word within a sentence is a name; one that begins a sentence is taken
    both as a word and, unless it is a common word (of a list, or in small letters in the benchmark and
    nowhere a name there), as a name. Items under WIDTH words are one run of all their words. Runs that are almost only
    placeholders don't count; items with no other are held by their words as they stand, numbers and
    names included, so that copies of them are found but not copies with other numbers. Null and empty texts and items leak nowhere;
    repeated rows of an id are one document, of an item one item. Other columns are not read.

    The bitmaps (runs, common words) are at most 2**BITS bits each however large the benchmark; all else are
    joins, in which the rows of a run that many documents hold are dealt over all tasks."""
    spark = session(docs)
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    items = benchmark.select(F.col(item_column).alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL").dropDuplicates().withColumn("own", F.xxhash64("text"))
    seen = items.mapInArrow(_words_seen, "slot long, small boolean, name boolean").groupBy("slot").agg(F.max("small").alias("small"), F.max("name").alias("name"))
    common = spark.sparkContext.broadcast(bitmap(seen.where("small AND NOT name").select("slot")).tobytes())

    def item_runs(sized, literal):
        def made(n):
            def run(batches):
                yield from _windows(None, common.value, [] if literal else [n], [n] if literal else [])(batches)

            return run

        short = sorted(r["n"] for r in sized.where(F.col("n") < WIDTH).select("n").distinct().collect())
        out = sized.where(F.col("n") >= WIDTH).select("id", "own", "text").mapInArrow(made(WIDTH), _ROWS.format(item_kind))
        for n in short:
            out = out.unionByName(sized.where(F.col("n") == n).select("id", "own", "text").mapInArrow(made(n), _ROWS.format(item_kind)))
        return save(out.select(F.col("id").alias("item"), "form", F.col("hash"), F.col("place").alias("item_place"), F.col("slot").alias("item_slot"), F.col("slots").alias("item_slots"))), short

    size = f"id {item_kind}, own long, text string, n int"
    wanted, short = item_runs(save(items.mapInArrow(_sizes(lambda x: template(x)[0]), size).where("n > 0")), False)
    bare = save(items.join(wanted.select(F.col("item").alias("id")).distinct(), "id", "left_anti").mapInArrow(_sizes(_literal_words), size).where("n > 0"))
    literal: list[int] = []
    if not bare.isEmpty():
        exact, literal = item_runs(bare, True)
        wanted, literal = wanted.unionByName(exact), [*literal, WIDTH]
    shared = spark.sparkContext.broadcast(bitmap(wanted.select(F.shiftrightunsigned("hash", 64 - BITS).alias("slot"))))
    widths = [WIDTH, *short]

    def run(batches):
        yield from _windows(shared.value, common.value, widths, literal)(batches)

    found = save(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("own", F.xxhash64("text")).mapInArrow(run, _ROWS.format(kind)).drop("form"))
    totals = wanted.groupBy("item", "form").agg(F.countDistinct("hash").alias("n_runs"))
    known = wanted.select("item", "form", "hash").distinct()
    counts = dealt_join(found.select("id", "hash").distinct(), known, "hash", "id").groupBy("id", "item", "form").agg(F.count("*").alias("n_found")).join(totals, ["item", "form"])
    pair = F.to_json(F.struct("id", "item", "form")).alias("pair")
    full = save(counts.where(F.col("n_found") >= F.col("n_runs") * SHARE).select(pair, "n_runs"))
    met = dealt_join(found.distinct(), wanted, "hash", "id").withColumn("pair", pair).join(full, "pair")
    judged = met.repartition("pair").sortWithinPartitions("pair", "own", "place", "item_place").mapInArrow(_judged, f"id {kind}, item {item_kind}, n_runs long, n_found long, containment double, consistency double")
    rank = F.struct("containment", "n_found", "n_runs", "consistency")
    judged = judged.groupBy("id", "item").agg(F.max(rank).alias("best")).select("id", "item", "best.n_runs", "best.n_found", "best.containment", "best.consistency")
    return judged.withColumnsRenamed({"id": id_column, "item": item_column})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
