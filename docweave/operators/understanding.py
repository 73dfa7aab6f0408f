"""What a question in a dialogue is about: mentions of entities, dependence on earlier turns, and the question rewritten to stand alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import text as tx

# Words before a tag, words before a number, and what a tag's first letters say.
EQUIPMENT_WORDS = (
    "Pump", "Valve", "Boiler", "Compressor", "Motor", "Tank", "Turbine", r"Heat\s+Exchanger", "Chiller", "Fan", "Blower", "Conveyor", "Generator",
    "Cooler", "Heater", "Reactor", "Column", "Vessel", "Separator", "Filter",
)
PROCEDURE_WORDS, INCIDENT_WORDS = ("SOP", "WI"), ("Incident", "Inc")
PAPER_WORDS = ("Report", "Doc", "Drawing", "Spec", "Standard", "Procedure", "Manual", "Guideline")
PREFIX_TYPES = {
    "P": "Pump", "V": "Valve", "TK": "Tank", "T": "Tank", "E": "HeatExchanger", "M": "Motor", "C": "Compressor", "L": "Pipeline", "FT": "Instrument", "PT": "Instrument",
    "LT": "Instrument", "TT": "Instrument", "FIC": "Instrument", "PIC": "Instrument", "PSV": "Valve", "PCV": "Valve", "BDV": "Valve", "SOP": "Procedure", "WI": "Procedure", "HX": "HeatExchanger",
}
# Words that stand for a thing, words that point back, and how a question goes on from another.
PRONOUNS = ("it", "its", "it's", "they", "them", "their", "theirs")
MARKERS = ("it", "its", "it's", "this", "that", "these", "those", "they", "them", "their", r"the\s+same", r"the\s+one", r"the\s+former", r"the\s+latter", "above", "previous")
OPENERS = (
    "what about", "how about", "and what", "and how", "and why", "and the", "what else", "anything else", "any others", "tell me more", "more on", "elaborate", "go on", "continue",
    "same for", "the same for", "compare", "compared to", "versus", "vs", "why", "why not", "how so", "such as", "for example", "and", "also",
)
#: Earlier messages looked at, entities and terms carried on, terms of a question that stands alone, and of one with its own topic.
LOOK_BACK, ENTITIES, TERMS, ALONE, OWN_TOPIC = 6, 2, 4, 3, 2

TAGGED = rf"(?i)\b({'|'.join(EQUIPMENT_WORDS)})\s+([A-Z]{{1,4}}\s*[-–—/]?\s*[0-9]{{1,6}})\b"
NUMBERED = rf"(?i)\b({'|'.join(PROCEDURE_WORDS + INCIDENT_WORDS + PAPER_WORDS)})\s*[-–—]?\s*([0-9]{{2,6}}(?:[-–—][0-9]{{1,4}})?(?:[-–—][0-9]{{1,4}})?)\b"
BARE = r"\b([A-Z]{1,4}\s*[-–—/]?\s*[0-9]{2,6})\b"
KIND = "array<struct<name:string,type:string,original:string,confidence:double>>"


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def canonical(tag: Column) -> Column:
    """A tag without spaces, in capitals, with a dash before its number."""
    plain = F.upper(F.regexp_replace(F.regexp_replace(tag, r"\s+", ""), "[–—/]", "-"))
    return let(plain, lambda p: F.when(F.contains(p, F.lit("-")), p).otherwise(F.regexp_replace(p, "^([A-Z]+)([0-9]+)$", "$1-$2")))


def tag_type(tag: Column) -> Column:
    """(type, confidence): what a tag's prefix names, by the whole prefix or its longest known beginning, and how sure that is."""
    known = F.create_map(*[F.lit(x) for pair in PREFIX_TYPES.items() for x in pair])
    by = lambda p: F.struct(F.element_at(known, p).alias("whole"), F.coalesce(*[F.element_at(known, F.substring(p, 1, n)) for n in (4, 3, 2, 1)]).alias("part"))
    told = lambda t: F.struct(F.coalesce(t["whole"], t["part"], F.lit("Equipment")).alias("type"), F.when(t["whole"].isNotNull(), 0.9).when(t["part"].isNotNull(), 0.85).otherwise(0.6).alias("confidence"))
    return let(F.regexp_replace(tag, "[-0-9]+$", ""), lambda p: let(by(p), told))


def mentions(text: Column) -> Column:
    """(name, type, original, confidence) of the entities that a text names, each once: words with tags, then numbered papers, then bare tags. A text is searched once for each pattern, and one without digits not at all; groups come from what was found."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def tags(pattern: str, group: int) -> Column:
        def one(x: Column) -> Column:
            typed = lambda n: let(tag_type(n), lambda t: F.struct(n.alias("name"), t["type"].alias("type"), x.alias("original"), t["confidence"].alias("confidence")))
            return let(canonical(F.regexp_extract(x, pattern, group)), typed)

        return F.transform(found(pattern), one)

    def paper(x: Column) -> Column:
        word = F.regexp_extract(x, NUMBERED, 1)
        among = lambda words: F.lower(word).isin(*[w.lower() for w in words])
        kind = F.when(among(PROCEDURE_WORDS), "Procedure").when(among(INCIDENT_WORDS), "Failure").otherwise("Document")
        return F.struct(F.concat(F.upper(word), F.lit("-"), F.regexp_extract(x, NUMBERED, 2)).alias("name"), kind.alias("type"), x.alias("original"), F.lit(0.9).alias("confidence"))

    papers = F.transform(found(NUMBERED), paper)
    all_ = F.concat(tags(TAGGED, 2).cast(KIND), papers.cast(KIND), tags(BARE, 1).cast(KIND))
    return F.when(text.rlike("[0-9]"), firsts(all_, lambda x: x["name"])).otherwise(F.array().cast(KIND))


def firsts(array: Column, key) -> Column:
    """The first element of each key, in order; the array and its keys are made once."""
    return let(array, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def leans_back(question: Column, own: Column, terms: Column) -> Column:
    """Whether a question needs earlier turns. own, terms: its entities and terms."""
    low = F.lower(question)
    bare = F.ltrim(low, F.lit("\"'( "))
    opener = F.exists(tx.strings(list(OPENERS)), lambda o: (bare == o) | F.startswith(bare, F.concat(o, F.lit(" "))))
    points = low.rlike(rf"\b({'|'.join(MARKERS)})\b")
    none = F.size(own) == 0
    return F.when(~none & (F.size(terms) >= ALONE), False).otherwise((points & none) | opener | (none & (F.size(terms) < ALONE)))


def with_history(dialogues: DataFrame) -> DataFrame:
    """`dialogues` (conv_id, turn, role, content) with the last LOOK_BACK messages before each, newest first."""
    own = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-LOOK_BACK, -1)
    return dialogues.withColumn("history", F.reverse(F.collect_list(F.struct("role", "content")).over(own)))


def prior(question: Column, history: Column, own: Column, terms: Column) -> tuple[Column, Column]:
    """Entities and terms that earlier messages, newest first, lend to a question; terms only of users, and only to a question with hardly any of its own."""
    low = lambda a: F.transform(a, F.lower)
    named = F.flatten(F.transform(history, lambda m, i: F.transform(mentions(m["content"]), lambda e: F.struct(e["name"].alias("word"), F.lower(e["name"]).alias("key"), i.alias("at")))))
    known = low(F.transform(own, lambda e: e["name"]))
    entities = firsts(F.filter(named, lambda e: ~F.array_contains(known, e["key"])), lambda e: e["key"])
    asked = F.flatten(F.transform(history, lambda m, i: F.when(m["role"] == "user", F.transform(tx.query_terms(m["content"]), lambda t: F.struct(t.alias("word"), F.lower(t).alias("key"), i.alias("at")))).otherwise(F.array())))
    used = F.array_union(low(terms), known)
    fresh = F.filter(asked, lambda t: ~F.array_contains(used, t["key"]) & ~F.exists(entities, lambda e: (e["key"] == t["key"]) & (e["at"] <= t["at"])))
    words = F.when(F.size(terms) < OWN_TOPIC, firsts(fresh, lambda t: t["key"])).otherwise(F.array())
    plain = lambda a, n: F.slice(F.transform(a, lambda x: x["word"]), 1, n)
    return plain(entities, ENTITIES), plain(words, TERMS)


def rewritten(question: Column, entities: Column, terms: Column) -> Column:
    """The question with its pronouns replaced by the first entity, and what isn't in it appended."""
    swapped = F.when(F.size(entities) > 0, F.regexp_replace(question, F.lit(rf"(?i)\b({'|'.join(PRONOUNS)})\b"), F.get(entities, 0))).otherwise(question)
    held = lambda item: F.regexp_like(swapped, F.concat(F.lit(r"(?i)(^|\W)\Q"), item, F.lit(r"\E($|\W)")))
    return F.trim(F.concat_ws(" ", swapped, F.array_join(F.filter(F.concat(entities, terms), lambda item: ~held(item)), " ")))


def resolved(dialogues: DataFrame) -> DataFrame:
    """conv_id, turn, question, search_query, follow_up, entities, terms, note of each question of a user."""
    rows = with_history(dialogues).where("role = 'user'").select("conv_id", "turn", F.col("content").alias("question"), "history")
    rows = rows.withColumns({"own": mentions(F.col("question")), "asked": tx.query_terms(F.col("question"))})
    rows = rows.withColumn("follow_up", (F.size("history") > 0) & leans_back(F.col("question"), F.col("own"), F.col("asked")))
    entities, terms = prior(F.col("question"), F.col("history"), F.col("own"), F.col("asked"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"entities": F.when(F.col("follow_up"), entities).otherwise(none), "terms": F.when(F.col("follow_up"), terms).otherwise(none)})
    rows = rows.withColumn("search_query", F.when(F.col("follow_up"), rewritten(F.col("question"), F.col("entities"), F.col("terms"))).otherwise(F.col("question")))
    note = F.when(F.col("search_query") != F.col("question"), F.concat(F.lit("Read in context as: "), "search_query")).otherwise("")
    return rows.select("conv_id", "turn", "question", "search_query", "follow_up", "entities", "terms", note.alias("note"))


#: How a statement about oneself reads, and the relation it gives.
STATEMENTS = (
    (r"(?i)\b(?:my name is|i am called) ([\p{L}]+(?: [\p{L}]+)*)", "HAS_NAME"),
    (r"(?i)\bi manage (?:the |a |an )?([^.!?\n]+)", "OWNS"),
    (r"(?i)\bi work (?:for|at|in) (?:the )?([^.!?\n]+)", "WORKS_AT"),
    (r"(?i)\bi (?:am a|am an|have role) ([^.!?\n]+)", "HAS_ROLE"),
)


def statements(said: DataFrame, user: str, text: str, rules: tuple = STATEMENTS) -> DataFrame:
    """(user, relation, object) of what users say of themselves; a managed thing with a tag is named by it."""
    tag = lambda o: F.get(F.transform(mentions(o), lambda e: e["name"]), 0)
    one = lambda p, r: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda o: F.struct(F.lit(r).alias("relation"), F.trim(o).alias("object")))
    rows = said.select(user, F.explode(F.concat(*[one(p, r) for p, r in rules])).alias("t")).select(user, "t.relation", "t.object")
    return rows.withColumn("object", F.when(F.col("relation") == "OWNS", F.coalesce(tag(F.col("object")), F.col("object"))).otherwise(F.col("object"))).distinct()
