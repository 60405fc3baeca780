"""Personal data: patterns, then information-theoretic sanitisation of what reveals them.

Emails, addresses, card and phone numbers are found by linear-time patterns, keys (long
runs of letters and digits) beside them; all of them are protected entities.  Exact values
seldom recur, so entities are protected at three levels: the value, its group (the mail
domain, the first two numbers of an address, the issuer digits of a card, the first digits
of a phone number) and its kind.  The whole corpus tells how strongly a term reveals an entity:

    PMI(term; entity) = log2(P(entity | term) / P(entity)),  IC(entity) = -log2 P(entity)

and the disclosure PMI / IC is 1 when every document with the term has the entity.

* A value is revealed by terms beside it (within ``CONTEXT`` code points) that reach the
  thresholds in ``SUPPORT`` documents or more; they are touched there only.
* A group is revealed by terms beside its values, a kind by terms anywhere in the
  document.  People are counted, not documents: documents whose first protected value is
  the same are one, so a thousand copies of one letter prove nothing about its words.
  ``SMOOTHING`` people without the term's habit are added to each estimate in place of a
  support limit.  Terms that reveal a group are touched beside it, those that reveal a
  kind wherever they stand outside of an entity.

Terms from a disclosure of ``GENERALISE`` on are spans of kind ``term`` and generalised,
from ``REMOVE`` on they are removed.

Everything is a built-in expression: matches come from regexp_extract_all, their offsets
from the lengths of the pieces that split leaves between them, summed in two levels.
Frequencies are aggregated before each shuffle; no join multiplies rows of one key by
another's.  Only terms that documents with an entity hold often enough are counted in the
rest of the corpus.

Null texts are empty and have no spans (and stay null in ``sanitise``).  Rows equal in id
and text share one result.  Null ids are allowed; ``sanitise`` carries all other columns of
the input in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, prepare, row_key, table

#: The kinds in order.  The guards keep the leftmost matches of the plain
#: patterns and make a search linear in the text.
KINDS = ["email", "ip", "card", "phone"]
#: A protected kind beside the base kinds, and what it looks like.
KEY, KEY_PATTERN = "key", r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth a search.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "key": "<KEY>", "generalise": "<TERM>", "remove": ""}

#: Code points on either side of an entity, and the shortest term.
CONTEXT = 64
TERM = r"\p{L}+"
TERM_LENGTH = 3
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.99
SMOOTHING = 2.0
#: Characters of revealing terms and candidates that may be broadcast; beyond that they are joined by shuffles.
BROADCAST_CHARACTERS = 4 << 20

SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _located(text: Column, pattern: str) -> Column:
    """start, end and value of every match, in code points."""

    def place(p: Column, m: Column) -> Column:
        n = F.size(m)
        last = n - 1
        step = F.ceil(F.sqrt(n)).cast("int")
        block = lambda i: F.floor(i / step).cast("int")
        sizes = F.transform(F.sequence(F.lit(0), last), lambda i: F.length(F.get(p, i)) + F.length(F.get(m, i)))

        def starts(size: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), block(last)), lambda j: _total(F.slice(size, j * step + 1, step)))

            def spans(tops: Column) -> Column:
                def span(i: Column) -> Column:
                    inner = _total(F.slice(size, block(i) * step + 1, i - block(i) * step))
                    start = F.get(tops, block(i)) + inner + F.length(F.get(p, i))
                    return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("value")))

                return F.transform(F.sequence(F.lit(0), last), span)

            return let(sums, lambda s: let(F.transform(F.sequence(F.lit(0), block(last)), lambda j: _total(F.slice(s, F.lit(1), j))), spans))

        return let(sizes, starts)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda p: place(p, m))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _base(text: Column) -> Column:
    """All base spans by kind, then start."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(_located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
        found = F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9]")
        return F.when(hint, found).otherwise(F.array().cast(SPANS))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _keys(text: Column, base: Column) -> Column:
    """Spans of keys: letters and digits mixed, outside of the base spans."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    found = F.filter(_located(text, KEY_PATTERN), lambda x: mixed(x["value"]) & free(x))
    found = F.transform(found, lambda x: F.struct(F.lit(len(KINDS)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(text.rlike(r"[A-Za-z0-9]{20}"), found).otherwise(F.array().cast(SPANS))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _group(span: Column) -> Column:
    """The group of a base span, which recurs where its value does not."""
    names, v = F.array(*map(F.lit, KINDS)), span["value"]
    mail, net, first = F.lower(F.substring_index(v, "@", -1)), F.substring_index(v, ".", 2), F.substring(_digits(v), 1, 4)
    return F.concat_ws(":", F.get(names, span["kind"]), F.when(span["kind"] == 0, mail).when(span["kind"] == 1, net).otherwise(first))


def _kinds(base: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, KEY]))
    return F.array_distinct(F.transform(base, lambda x: F.get(names, x["kind"])))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.length(w) >= TERM_LENGTH))


def _contexts(text: Column, base: Column) -> Column:
    """entity, group, term, start and end of the terms within CONTEXT of a base span."""
    size = F.length(text)

    def around(spans: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            floor = F.coalesce(F.when(i > 0, F.get(spans, i - 1)["end"]), F.lit(0))
            ceiling = F.coalesce(F.get(spans, i + 1)["start"], size)
            left = F.greatest(floor, x["start"] - CONTEXT)
            right = F.least(ceiling, x["end"] + CONTEXT)

            def terms(a: Column, b: Column, whole_left: Column, whole_right: Column) -> Column:
                part = F.substr(text, a + 1, F.greatest(b - a, F.lit(0)))
                whole = lambda t: (F.length(t["value"]) >= TERM_LENGTH) & (whole_left | (t["start"] > 0)) & (whole_right | (t["end"] < b - a))
                return F.transform(
                    F.filter(_located(part, TERM), whole),
                    lambda t: F.struct(_entity(x).alias("entity"), _group(x).alias("group"), F.lower(t["value"]).alias("term"), (t["start"] + a).alias("start"), (t["end"] + a).alias("end")),
                )

            # A word that touches the far edge of a context may be cut and is left out.
            return F.concat(terms(left, x["start"], left == 0, F.lit(True)), terms(x["end"], right, F.lit(True), right == size))

        return F.flatten(F.transform(spans, one))

    ordered = F.array_sort(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))))
    none = F.array().cast("array<struct<entity:string,group:string,term:string,start:int,end:int>>")
    return F.when(F.size(base) == 0, none).otherwise(let(ordered, around))


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    d = docs.select(*more, F.col(id_col).alias("id"), F.col(text_col).alias("source"))
    return d.withColumn("key", F.unhex(row_key(F.col("id"), F.col("source"))))


def value_pairs(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """entity, term and n of the terms that stand beside a value in enough documents."""
    pairs = found.select(F.explode(F.array_distinct(F.transform("contexts", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("p"))
    return cut(pairs.groupBy("p.entity", "p.term").agg(F.count("*").alias("n")).filter(F.col("n") >= support))


def disclosing(found: DataFrame, pairs: DataFrame, df: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """entity, term and action of the value_pairs() that reach the thresholds; df has the documents of each term."""
    entities = found.select(F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    total = found.agg(F.count("*").cast("double")).first()[0]
    scored = pairs.join(entities, "entity").join(df, "term")
    pmi = F.log2(F.col("n") * F.lit(total) / (F.col("all") * F.col("df_entity")))
    ic = F.log2(F.lit(total) / F.col("df_entity"))
    scored = scored.withColumn("disclosure", F.when(ic > 0, pmi / ic)).filter(F.col("disclosure") >= generalise)
    return scored.select("entity", "term", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def _small(df: DataFrame, text: str) -> DataFrame:
    """A stored table with a broadcast hint if its texts are few enough."""
    size = df.agg(F.coalesce(F.sum(F.length(text) + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_CHARACTERS else df


def described(docs: DataFrame) -> DataFrame:
    """id, key, and what (id, key, source) rows hold: entities, the terms beside them, the terms outside of them, their groups and kinds, and one value that stands for the person."""
    spans = docs.select("id", "key", "source", _base(F.col("source")).alias("base"))
    spans = spans.select("id", "key", "source", F.concat("base", _keys(F.col("source"), F.col("base"))).alias("base"))
    blanks = F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(" ").alias("put"))))
    none, held = F.array().cast("array<string>"), F.size("base") > 0
    plain = F.filter("base", lambda x: x["kind"] < len(KINDS))
    return spans.select(
        "id",
        "key",
        "base",
        _contexts(F.col("source"), plain).alias("contexts"),
        F.when(held, _terms(let(blanks, lambda b: _replaced(F.col("source"), b)))).otherwise(none).alias("terms"),
        F.array_distinct(F.transform(plain, _group)).alias("groups"),
        _kinds(F.col("base")).alias("kinds"),
        F.xxhash64(F.array_min(F.transform("base", _entity))).alias("person"),
    )


def _disclosure(df: Column, smoothing: float) -> Column:
    return F.log2((F.col("n") + smoothing * F.col("p")) / (df + smoothing) / F.col("p")) / -F.log2("p")


def class_pairs(found: DataFrame, generalise: float = GENERALISE, smoothing: float = SMOOTHING) -> DataFrame:
    """class, term, n (people), n_docs and p of the terms that may reveal a kind (by standing in the document) or a group (by standing beside it).

    A term is in as many documents at least as those with an entity that hold it, which bounds
    its disclosure before the rest of the corpus is counted.
    """
    total = float(found.count())
    held = found.filter(F.size("base") > 0)
    classes = held.select(F.explode(F.concat("kinds", "groups")).alias("class"), "person").groupBy("class", "person").agg(F.count("*").alias("d")).groupBy("class").agg(F.count("*").alias("people"), F.sum("d").alias("docs"))
    classes = classes.select("class", (F.col("people") / (F.lit(total) - F.col("docs") + F.col("people"))).alias("p")).filter("p < 1")
    by_kind = held.select(F.explode("terms").alias("term"), "kinds", "person").select(F.explode("kinds").alias("class"), "term", "person")
    beside = F.array_distinct(F.transform("contexts", lambda c: F.struct(c["group"].alias("class"), c["term"].alias("term"))))
    by_group = held.select(F.inline(beside), "person")
    pairs = by_kind.union(by_group).groupBy("class", "term", "person").agg(F.count("*").alias("d")).groupBy("class", "term").agg(F.count("*").alias("n"), F.sum("d").alias("n_docs"))
    among = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("among"))
    least = F.col("n") + F.greatest(F.coalesce("among", F.lit(0)) - F.col("n_docs"), F.lit(0))
    pairs = pairs.join(classes, "class").filter(_disclosure(F.col("n"), smoothing) >= generalise).join(among, "term", "left")
    return cut(pairs.filter(_disclosure(least, smoothing) >= generalise).drop("among"))


def revealing(pairs: DataFrame, df: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, smoothing: float = SMOOTHING) -> DataFrame:
    """class, term, n, df, disclosure and action of the class_pairs() that reach the thresholds; df has the documents of each term."""
    scored = pairs.join(df, "term").withColumn("df", F.col("n") + F.col("all") - F.col("n_docs"))
    scored = scored.withColumn("disclosure", _disclosure(F.col("df"), smoothing)).filter(F.col("disclosure") >= generalise)
    return scored.select("class", "term", "n", "df", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def document_counts(words: DataFrame, *pairs: DataFrame) -> DataFrame:
    """term and all, the documents that hold it, of the terms of some pairs; one pass over (key, term) of the corpus."""
    wanted = pairs[0].select("term")
    for other in pairs[1:]:
        wanted = wanted.union(other.select("term"))
    # Counted before the join: a count is one row for each term and task, whatever the candidates are.
    return cut(words.groupBy("term").agg(F.count("*").alias("all")).join(_small(cut(wanted.distinct()), "term"), "term"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, base spans (kind, start, end, value; keys last) and terms (start, end, action) of each row."""
    d = _keyed(docs, id_col, text_col).withColumn("source", F.coalesce("source", F.lit("")))
    found = cut(described(d))
    values, classes = value_pairs(found), class_pairs(found)
    words = d.select("key", F.explode(_terms(F.col("source"))).alias("term"))
    df = document_counts(words, values, classes)

    span = ["key", "start", "end", "action"]
    near = found.filter(F.size("contexts") > 0).select("key", F.inline("contexts"))
    told = cut(revealing(classes, df).select("class", "term", "action"))
    places = near.join(disclosing(found, values, df), ["entity", "term"]).select(span)
    places = places.union(near.join(told.withColumnRenamed("class", "group"), ["group", "term"]).select(span))
    kinds = cut(told.filter(F.col("class").isin([*KINDS, KEY])).groupBy("term").agg(F.max("action").alias("action")))
    if not kinds.isEmpty():
        places = places.union(_anywhere(d, words, found, kinds).select(span))

    # A term that several ways name takes the stronger action.
    terms = places.groupBy("key", "start", "end").agg(F.max("action").alias("action"))
    terms = terms.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.select("id", "key", "base").join(terms, "key", "left").withColumn("terms", F.coalesce("terms", none))


def _anywhere(d: DataFrame, words: DataFrame, found: DataFrame, kinds: DataFrame) -> DataFrame:
    """key, start, end and action wherever one of the terms stands outside of an entity."""
    hits = words.join(_small(kinds, "term"), "term").groupBy("key").agg(F.collect_set(F.struct("term", "action")).alias("told"))
    hits = cut(hits.join(found.select("key", "base").dropDuplicates(["key"]), "key"))
    # Few documents hold such a term as a rule; then no text is shuffled for them.
    size = F.length(F.to_json(F.struct("told", "base"))) + 16
    if (hits.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_CHARACTERS:
        hits = F.broadcast(hits)
    actions = F.map_from_entries("told")
    places = F.transform(_located(F.col("source"), TERM), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), actions[F.lower(t["value"])].alias("action")))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return d.select("key", "source").join(hits, "key").select("key", F.inline(F.filter(places, lambda x: x["action"].isNotNull() & free(x))))


def _listed(spans: Column, kind) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    names = F.array(*map(F.lit, [*KINDS, KEY]))
    listed = lambda spans: _listed(spans, lambda x: F.get(names, x["kind"]))
    base = listed(F.filter("base", lambda x: x["kind"] < len(KINDS)))
    terms = _listed(F.array_distinct(F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))), lambda x: F.lit("term"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return find(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(listed(F.col("base")), terms), ",").alias("spans"),
        count(len(KINDS)).alias("n_key"),
        F.size("terms").cast("long").alias("n_term"),
        (F.size("base") + F.size("terms")).cast("long").alias("n_spans"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, put) replaced; overlapping spans take the first's place."""

    def piece(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(between, s["put"]))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, piece, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the input's columns), base, terms and the sanitised text of each row."""
    found = find(docs, id_col, text_col).filter((F.size("base") > 0) | (F.size("terms") > 0)).select("key", "base", "terms").dropDuplicates(["key"])
    put = F.array(*[F.lit(PLACEHOLDERS[k]) for k in [*KINDS, KEY]])
    spans = F.concat(
        F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(put, x["kind"]).alias("put"))),
        F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "remove", PLACEHOLDERS["remove"]).otherwise(PLACEHOLDERS["generalise"]).alias("put"))),
    )
    d = _keyed(docs, id_col, text_col, F.struct("*").alias("row")).join(found, "key", "left")
    d = d.select("row", "source", "base", "terms", F.array_sort(spans).alias("spans"))
    text = F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, _replaced(F.col("source"), F.col("spans"))).otherwise(F.col("source"))
    return d.select("row", "base", "terms", text.alias("text"))
