"""Personal data: protected entities, and the terms that disclose them, found by corpus co-occurrence.

Protected entities are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, each
found by a pattern. A term is a word of three letters or more that stands alone, not in an address
or beside a digit. It occurs with an entity in a document where it stands within CONTEXT code
points of a mention. With the information content IC(e) = log2(N / documents with e), the pointwise
mutual information PMI(t, e) = log2(P(e | t) / P(e)) says how many of these bits the term gives
away; P(e | t) is the share of the documents with t in which t occurs with e (one document is added
to those with t, so a few documents prove less). A term is disclosing if PMI >= DISCLOSURE x IC for
some entity and they occur together in at least MIN_TEXTS different texts.

A disclosing term is generalised to the class of words with its first CLASS letters, written as
these and a star, if the class as a whole stays below the threshold for each of the term's entities
(counts of a class are sums over its words), and removed if not. Terms are disclosing wherever they
stand. Everything is DataFrame functions; counts cover all documents.

Places come from splitting a text at the matches and adding up lengths, so they count code points.
A document is told apart by its doc_id and a hash of its text. Results for odd input: null and empty
texts have no spans; very long texts are processed whole, and their mentions are rows; repeated
rows of a document are each answered and count as one mention, but each in the documents with a
term; equal spans of kinds may overlap, those of terms overlap no other; an empty table gives no
rows; where an entity is in every document nothing discloses it; other columns pass through
`sanitise` and are not read by `private_spans`, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill.llm import common as c

KINDS = ("email", "ip", "card", "phone", "term")
TERM_KIND = 4
LOCAL = "[A-Za-z0-9._%+-]"
# Each finds what the plain pattern finds from left to right, without trying a run of characters from each of its places.
PATTERNS = (
    rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
HINTS = ("@", ".", None, "+")  # a text without its hint has no match
LABELS = ("[email]", "[ip]", "[card]", "[phone]")
TERM = r"(?<![\p{L}\p{M}\p{N}@._%+-])\p{L}{3,}+(?![\p{M}\p{N}@_%+-]|\.[\p{L}\p{N}])"
DIGITS = "[^0-9]"

CONTEXT = 100
MIN_TEXTS = 3
DISCLOSURE = 0.9
CLASS = 3
CHUNK = 1000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, DIGITS, "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(values, F.lit(0), lambda total, x: total + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _small_part(part: Column) -> Column:
    return part.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")


def is_valid(kind: int, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of its entities."""
    if kind == 1:
        return F.forall(F.split(value, r"\."), _small_part)
    digits = _digits(value)
    if kind == 2:
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == 3 else F.lit(True)


def _entity(kind: int, value: Column) -> Column:
    """What the value is counted as, however it is written."""
    return F.concat(F.lit(f"{KINDS[kind]}:"), F.lower(value) if kind == 0 else value if kind == 1 else _digits(value))


def _parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """The pieces of a text between the matches of a pattern, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)


def _numbers(values: Column) -> Column:
    """0 .. size - 1, or nothing."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))


def _matches(kind: int, pieces: Column, values: Column) -> Column:
    """Structs of a text's matches: kind, number, gap (code points since the match before), value, and what stands around.

    The arrays must be columns of their own, or each match would split the text again.
    """

    def of(i: Column) -> Column:
        piece, after, value = F.get(pieces, i), F.get(pieces, i + 1), F.get(values, i)
        # words cut by the context's edge go, as do those that run into the mention
        left = F.when(F.length(piece) > CONTEXT, F.regexp_replace(F.right(piece, F.lit(CONTEXT)), r"^[\p{L}\p{M}\p{N}]+", "")).otherwise(piece)
        right = F.when(F.length(after) > CONTEXT, F.regexp_replace(F.left(after, F.lit(CONTEXT)), r"[\p{L}\p{M}\p{N}]+$", "")).otherwise(after)
        around = F.concat(left, F.left(value, F.lit(1)), F.lit("\n"), F.right(value, F.lit(1)), right)
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("number"),
            F.length(piece).alias("gap"),
            value.alias("value"),
            _entity(kind, value).alias("entity"),
            is_valid(kind, value).alias("valid"),
            around.alias("around"),
        )

    return F.when(values.isNotNull(), F.transform(_numbers(values), of))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))


DOCUMENT = ("doc_id", "mark")


def mentions(docs: DataFrame) -> DataFrame:
    """One row for each mention of a protected entity: doc_id, mark, kind, start, end, entity, around."""
    text, arrays = F.col("text"), {}
    for kind in range(TERM_KIND):
        hinted = F.lit(True) if HINTS[kind] is None else F.contains(text, F.lit(HINTS[kind]))
        pieces, values = _parts(text, PATTERNS[kind])
        arrays |= {f"pieces{kind}": F.when(hinted, pieces), f"values{kind}": F.when(hinted, values)}
    texts = _identified(docs).withColumns(arrays)
    matches = [_matches(kind, F.col(f"pieces{kind}"), F.col(f"values{kind}")) for kind in range(TERM_KIND)]
    found = F.explode(F.flatten(F.filter(F.array(*matches), F.isnotnull))).alias("found")
    rows = texts.select(*DOCUMENT, found).select(*DOCUMENT, "found.*").dropDuplicates([*DOCUMENT, "kind", "number"])
    upto = Window.partitionBy(*DOCUMENT, "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.length("value")).over(upto)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.where("valid").select(*DOCUMENT, "kind", "start", "end", "entity", "around")


def term_counts(docs: DataFrame) -> DataFrame:
    """The number of documents with each term (term, n)."""
    terms = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col("text").cast("string"), F.lit(TERM), 0), F.lower)))
    return docs.select(terms.alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _disclosed(together: Column, with_term: Column, with_entity: Column, n_docs: int) -> Column:
    """PMI / IC: the share of the entity's information that the term gives away."""
    information = F.log2(F.lit(float(n_docs)) / with_entity)
    return F.when(information > 0, 1 + F.log2(together / (with_term + 1)) / information)


def disclosing_terms(
    docs: DataFrame, found: DataFrame, threshold: float = DISCLOSURE, min_texts: int = MIN_TEXTS, letters: int = CLASS
) -> DataFrame:
    """term, disclosed (the largest share over all entities) and instead: the class it is generalised to, or '' if it goes."""
    counts = c.stored(term_counts(docs))
    n_docs = docs.count()
    around = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("around", F.lit(TERM), 0), F.lower))).alias("term")
    beside = found.select("entity", *DOCUMENT, around).dropDuplicates(["entity", "term", *DOCUMENT])
    # documents of one text count as one for the support: first by text, then over texts
    by_text = beside.groupBy("entity", "term", "mark").agg(F.count("*").alias("n"))
    together = c.stored(by_text.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("texts")))
    with_entity = found.select("entity", *DOCUMENT).dropDuplicates().groupBy("entity").agg(F.count("*").alias("with_entity"))

    enough = together.where(F.col("texts") >= min_texts)
    shares = enough.join(with_entity, "entity").join(counts, "term")
    disclosed = _disclosed(F.col("together"), F.col("n"), F.col("with_entity"), n_docs)
    disclosing = c.stored(shares.select("entity", "term", "with_entity", disclosed.alias("disclosed")).where(F.col("disclosed") >= threshold))

    def of_class(term: str) -> Column:
        return F.left(F.col(term), F.lit(letters)).alias("class")

    wanted = disclosing.select("entity", of_class("term"), "with_entity").distinct()
    sizes = counts.groupBy(of_class("term")).agg(F.sum("n").alias("class_n"))
    joint = together.groupBy("entity", of_class("term")).agg(F.sum("together").alias("class_together"))
    classes = wanted.join(sizes, "class").join(joint, ["entity", "class"])
    share = _disclosed(F.col("class_together"), F.col("class_n"), F.col("with_entity"), n_docs)
    classes = classes.select("entity", "class", (share < threshold).alias("hides"))
    judged = disclosing.withColumn("class", F.left("term", F.lit(letters))).join(classes, ["entity", "class"])
    judged = judged.groupBy("term", "class").agg(F.max("disclosed").alias("disclosed"), F.every("hides").alias("hides"))
    instead = F.when(F.col("hides"), F.concat("class", F.lit("*"))).otherwise("")
    return c.stored(judged.select("term", "disclosed", instead.alias("instead")))


def documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, mark and instead (a map by term) for the documents that hold a disclosing term."""
    own = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), 0), F.lower))).alias("term")
    # the stored table's size is known: Spark sends it to all tasks if it is small, and joins by shuffle if not
    held = _identified(docs).select(*DOCUMENT, own).join(terms.select("term", "instead"), "term").drop_duplicates()
    return held.groupBy(*DOCUMENT).agg(F.map_from_entries(F.collect_list(F.struct("term", "instead"))).alias("instead"))


def _with_terms(texts: DataFrame, held: DataFrame, how: str) -> DataFrame:
    held = held.select(F.col("doc_id").alias("held_id"), F.col("mark").alias("held_mark"), "instead")
    on = texts["doc_id"].eqNullSafe(held["held_id"]) & (texts["mark"] == held["held_mark"])
    return texts.join(held, on, how).drop("held_id", "held_mark")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, mark, kind, start and end of each disclosing term in the documents."""
    texts = _with_terms(_identified(docs), c.stored(documents_with(docs, terms)), "inner")
    pieces, values = _parts(F.col("text"), TERM)
    texts = texts.select(*DOCUMENT, "instead", pieces.alias("pieces"), values.alias("values"))
    # a row for each CHUNK words, in which the terms that go are placed; then the chunks are placed in the text
    chunks = F.expr(f"explode(sequence(0, (size(values) - 1) div {CHUNK})) AS number")
    chunks = texts.where(F.size("values") > 0).select("*", chunks)
    chunks = chunks.withColumns({x: F.slice(x, F.col("number") * CHUNK + 1, F.lit(CHUNK)) for x in ("pieces", "values")})
    folded = F.expr(
        """aggregate(
            zip_with(slice(pieces, 1, size(values)), values, (p, v) -> named_struct('gap', length(p), 'size', length(v), 'goes', map_contains_key(instead, lower(v)))),
            named_struct('upto', 0L, 'places', CAST(array() AS array<struct<start: bigint, end: bigint>>)),
            (a, w) -> named_struct('upto', a.upto + w.gap + w.size, 'places',
                if(w.goes, array_append(a.places, named_struct('start', a.upto + w.gap, 'end', a.upto + w.gap + w.size)), a.places)))"""
    )
    folded = chunks.select(*DOCUMENT, "number", folded.alias("folded")).select(*DOCUMENT, "number", "folded.*").dropDuplicates([*DOCUMENT, "number"])
    before = Window.partitionBy(*DOCUMENT).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("before", F.coalesce(F.sum("upto").over(before), F.lit(0)))
    place = placed.select(*DOCUMENT, "before", F.explode("places").alias("place"))
    return place.select(*DOCUMENT, F.lit(TERM_KIND).alias("kind"), (F.col("place.start") + F.col("before")).alias("start"), (F.col("place.end") + F.col("before")).alias("end"))


def _replaced(text: Column, pattern: str, instead) -> Column:
    """The text with instead(match) for each match of a pattern."""
    pieces, values = _parts(text, pattern)
    rest = F.zip_with(values, F.slice(pieces, 2, 1 << 30), lambda value, piece: F.concat(instead(value), piece))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows with disclosing terms generalised or removed, and then with labels for e-mail addresses,
    cards, phones and IP addresses, in this order: what one has masked the next no longer sees."""
    held = documents_with(docs, disclosing_terms(docs, c.stored(mentions(docs))))
    suffix = uuid.uuid4().hex  # so that no column of the rows has these names
    names = {x: f"{x}_{suffix}" for x in (*DOCUMENT, "instead")}
    held = held.withColumnsRenamed(names)
    rows = docs.withColumn(names["mark"], F.xxhash64(F.col("text").cast("string")))
    on = rows["doc_id"].eqNullSafe(held[names["doc_id"]]) & (rows[names["mark"]] == held[names["mark"]])
    rows = rows.join(held, on, "left")
    instead = F.col(names["instead"])
    text = F.col("text").cast("string")
    text = F.when(instead.isNull(), text).otherwise(_replaced(text, TERM, lambda x: F.coalesce(F.element_at(instead, F.lower(x)), x)))
    rows = rows.withColumn("text", text)
    for kind in (0, 2, 3, 1):
        masked = _replaced(F.col("text"), PATTERNS[kind], lambda x, kind=kind: F.when(is_valid(kind, x), F.lit(LABELS[kind])).otherwise(x))
        rows = rows.withColumn("text", F.when(F.col("text").rlike(PATTERNS[kind]), masked).otherwise(F.col("text")))
    return rows.select(*docs.columns)


def private_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of their spans), spans (of terms too), n_term."""
    found = c.stored(mentions(docs))
    terms = disclosing_terms(docs, found)
    all_spans = found.select(*DOCUMENT, "kind", "start", "end").unionByName(term_spans(docs, terms))
    span = F.struct("kind", "start", "end")
    of = all_spans.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(span)).alias("instead"))
    rows = _with_terms(_identified(docs).drop("text"), of, "left")

    def listed(spans: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    spans = F.coalesce("instead", F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>"))
    rows = rows.select("doc_id", spans.alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] < TERM_KIND)

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select(
        "doc_id", *(number(k) for k in range(TERM_KIND)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number(TERM_KIND)
    )
