"""Personal data replaced by keyed surrogates, with built-in functions only.

Entities are found by patterns and replaced by others of the same type and form: digits by digits, letters
by letters of the same case and script, names by names of the same gender and script, composed of syllables so
that they never run out, addresses by addresses of the same length; country codes stay, and check digits of cards and IBANs stay right. The
replacement is drawn from SHA-256 of a secret key, the type and the entity's canonical form (case and
punctuation do not matter), so that every mention of an entity gets the same surrogate everywhere
(coreference). A person has one gender over all titles of the table, and within a document the full name or
surname of a person with a title is replaced where it stands without one. A collision check over the
distinct entities of the whole table preserves distinctness: of entities that would get the same surrogate,
or a surrogate that is itself an entity of the table, all but one draw again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.numbering import join_hint
from jobloom.llm.scratch import discard, fresh, materialize

#: Forms of address by gender.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Señora|Sra|Doña|Госпожа|Κυρία"
OTHER_TITLES = "Dr|Prof"
#: Consonants and vowels that make the syllables of names, by script.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζθκλμνπρστφ", "αεηιο")}
#: What names end in, by script and gender (n: either), and what surnames do.
ENDINGS = {
    ("latin", "m"): "n r s l rd m ns rt", ("latin", "f"): "a ia na lla ea sa ra nne", ("latin", "n"): "i y ie ey e o ou u",
    ("latin", "last"): "mann ski son berg ez ni feld dal",
    ("cyrillic", "m"): "н р й м слав мир с т", ("cyrillic", "f"): "на ла ша ня ра са та мила", ("cyrillic", "n"): "ня ша ля ка ся ва жа тя",
    ("cyrillic", "last"): "нко ук ко вич х ян ун рь",
    ("greek", "m"): "ς νος ρης λος κος ων σης μος", ("greek", "f"): "να λα ρω σια νη τω κα λη", ("greek", "n"): "φι λι νι ρι κι τι μι πι",
    ("greek", "last"): "κης πουλος ιδης κος τος λας ρας νης",
}
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)

HEX = "0123456789abcdef"
#: Syllables of a name and of a surname; every second draw after a collision adds one to the surname, so that the
#: names never end: the first draw has some two million surnames, each syllable more makes them seventy times as many.
FIRST_SYLLABLES, LAST_SYLLABLES = 2, 3
#: Draws of the same length. A form such as ``a@b.co`` has few others, which may all be entities of the table;
#: later draws add a letter a draw, and octets take any value.
FORM_DRAWS = 6
#: Draws after which an entity whose form has no free surrogate gets a placeholder of its kind and 16 keyed signs.
MOST_DRAWS = 40

#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_HEX4, _NOT_HEX = "[0-9A-Fa-f]{1,4}", r"(?![\w:])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: A repeated group has a bound, as Java matches each turn of one by a deeper call; character classes need none. A
#: domain has at most 127 labels.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s*[:=]\s*)(?:\"[^\"\n]+\"|'[^'\n]+'|[^\s\"',;]+)",
    "cloud_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)",
    "ipv6": rf"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,7}}(?::{_HEX4}){{1,6}}|(?:{_HEX4}:){{1,7}}:|:(?::{_HEX4}){{1,7}}){_NOT_HEX}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "person": rf"\b(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?[ \u00A0]{_NAME}(?:[ \u00A0]{_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A character that every entity holds, the beginning of a key, or a title: texts without are passed over quickly.
MAY_HOLD = rf"[@\d:=]|A[KS]IA|\b(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\b"
_TITLE = rf"^((?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?[ \u00A0])"


def _titled(titles: str) -> str:
    return f"^(?:{titles})[. \u00A0]"


def describe(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``kind``, ``before`` and ``after`` (which stay), ``middle`` (which is replaced) and ``entity``.

    ``entity`` is ``kind:form``, the same for all spellings of an entity. The kind is the first whose
    pattern matches all of the value.
    """
    v, kind = F.col(value), F.lit("secret")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(v.rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    df = df.withColumn("kind", kind)
    kind, middle = F.col("kind"), F.col("middle")
    before = (
        F.when(kind == "secret", F.regexp_extract(v, r"^([^:=]*[:=]\s*[\"']?)", 1))
        .when(kind == "cloud_key", F.left(v, F.lit(4)))
        .when(kind == "phone", F.regexp_extract(v, rf"^(\+(?:{CALLING_CODES}|\d{{3}}))", 1))
        .when(kind == "iban", F.left(v, F.lit(2)))
        .when(kind == "card", F.left(v, F.lit(1)))
        .when(kind == "person", F.regexp_extract(v, _TITLE, 1))
        .otherwise("")
    )
    after = (
        F.when(kind == "secret", F.regexp_extract(v, r"([\"']?)$", 1))
        .when(kind == "email", F.regexp_extract(v, r"(\.[A-Za-z]+)$", 1))
        .otherwise("")
    )
    df = df.withColumn("before", before).withColumn("after", after)
    kept = F.length("before") + F.length("after")
    df = df.withColumn("middle", F.substring(v, F.length("before") + 1, F.length(v) - kept))
    form = (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(v, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(v, " ", ""))
        .when(kind == "email", F.lower(v))
        .when(kind == "person", F.regexp_replace(F.lower(middle), "[ \u00A0]+", " "))
        .when(kind.isin("ip", "ipv6"), F.lower(v))
        .otherwise(middle)
    )
    gender = F.when(F.col("before").rlike(_titled(MALE_TITLES)), "m").when(F.col("before").rlike(_titled(FEMALE_TITLES)), "f").otherwise("n")
    return df.withColumns({"entity": F.concat(kind, F.lit(":"), form), "gender": gender})


def _luhn(digits: Column) -> Column:
    """The digit that makes ``digits`` pass the check of card numbers."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capitals, which count from A: 10."""
    return F.aggregate(
        F.split(text, ""), F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.pmod(a * 10 + F.try_to_number(c, F.lit("9")).cast("int"), F.lit(97)))
        .otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def _with_check_digits(kind: Column, value: Column, drawn: Column) -> Column:
    """``drawn`` with right check digits, if ``value`` has them."""
    digits, new = F.regexp_replace(value, r"\D", ""), F.regexp_replace(drawn, r"\D", "")
    card = _luhn(F.left(digits, F.length(digits) - 1)) == F.right(digits, F.lit(1))
    fixed = F.concat(F.left(drawn, F.length(drawn) - 1), _luhn(F.left(new, F.length(new) - 1)))
    own, other = F.regexp_replace(value, " ", ""), F.regexp_replace(drawn, " ", "")

    def turned(iban: Column, check: Column) -> Column:
        return F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(2)), check)

    iban = _mod97(turned(own, F.substr(own, F.lit(3), F.lit(2)))) == 1
    check = F.lpad((98 - _mod97(turned(other, F.lit("00")))).cast("string"), 2, "0")
    signed = F.concat(F.left(drawn, F.lit(2)), check, F.substr(drawn, F.lit(5)))
    return F.when((kind == "card") & card, fixed).when((kind == "iban") & iban, signed).otherwise(drawn)


def _number(place: Column) -> Column:
    """32 bits of the column ``stream``, blocks of eight such numbers, at a place."""
    block = F.get("stream", F.floor(place / 8).cast("int"))
    return F.conv(F.substring(block, (F.pmod(place, F.lit(8)) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")


def _replaced(c: Column, place: Column) -> Column:
    """A letter or digit by another of its alphabet; any other character stays."""
    own = F.get(F.filter(F.array(*map(F.lit, ALPHABETS)), lambda a: F.instr(a, c) > 0), F.lit(0))
    letters = F.when(F.col("hexadecimal") & c.rlike("^[0-9a-fA-F]$"), F.when(F.col("middle").rlike("[A-F]"), HEX.upper()).otherwise(HEX)).otherwise(own)
    # Named once: an expression would be computed wherever it stands.
    drawn = F.transform(F.array(letters), lambda a: F.substring(a, (F.pmod(_number(place), F.length(a)) + 1).cast("int"), F.lit(1)))
    return F.coalesce(F.get(drawn, F.lit(0)), c)


def _name(script: Column, gender: Column, attempt: Column) -> tuple[Column, Column]:
    """A name of a script and gender, and a surname, composed of syllables."""
    syllables = F.create_map(*[x for of, (c, v) in SOUNDS.items() for x in (F.lit(of), F.array(*[F.lit(a + b) for a in c for b in v]))])
    endings = F.create_map(*[x for (of, which), ends in ENDINGS.items() for x in (F.lit(f"{of}/{which}"), F.array(*map(F.lit, ends.split())))])

    def composed(first: int, count: Column, which: Column) -> Column:
        known, ends = F.element_at(syllables, script), F.element_at(endings, F.concat(script, F.lit("/"), which))
        spoken = F.transform(F.sequence(F.lit(1), count), lambda i: F.get(known, F.pmod(_number(i + first), F.size(known)).cast("int")))
        ending = F.get(ends, F.pmod(_number(F.lit(first)), F.size(ends)).cast("int"))
        return F.initcap(F.concat(F.array_join(spoken, ""), ending))

    more = F.floor(F.greatest(attempt, F.lit(0)) / 2).cast("int")
    return composed(0, F.lit(FIRST_SYLLABLES), gender), composed(FIRST_SYLLABLES + 1, F.lit(LAST_SYLLABLES) + more, F.lit("last"))


def with_surrogates(df: DataFrame, secret: str) -> DataFrame:
    """Add ``surrogate`` to a described table with ``value``, ``gender`` and ``attempt`` (draws after collisions; -1: a placeholder)."""
    # Long entities are hashed once, outside the blocks' function, and their blocks from that.
    key = F.sha2(F.concat(F.lit(f"{secret}|"), "entity", F.lit("|"), F.col("attempt").cast("string")), 256)
    changeable = F.col("middle").rlike(f"[{''.join(ALPHABETS)}]")  # else there is nothing to draw but letters to add
    added = F.greatest(F.lit(0), F.col("attempt") + F.when(changeable, 1 - FORM_DRAWS).otherwise(1))
    df = df.withColumn("added", F.when(F.col("kind").isin("email", "secret"), added).otherwise(0))
    named = F.col("kind") == "person"
    syllables = FIRST_SYLLABLES + LAST_SYLLABLES + 2 + F.greatest(F.col("attempt"), F.lit(0))
    numbers = F.when(named, syllables).otherwise(F.length("middle") + F.col("added"))
    blocks = F.sequence(F.lit(0), F.floor(numbers / 8).cast("int"))
    streams = F.transform(F.array(key), lambda k: F.transform(blocks, lambda j: F.sha2(F.concat(k, F.lit("|"), j.cast("string")), 256)))
    df = df.withColumn("stream", F.get(streams, F.lit(0)))
    hexadecimal = (F.col("kind") == "secret") & F.col("middle").rlike("^[0-9a-f]+$")
    df = df.withColumn("hexadecimal", hexadecimal | (F.col("kind") == "ipv6"))
    # Punctuation takes no place, so that all spellings of an entity draw alike.
    sign = r"[\p{L}\d]"
    signs = F.when(named, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("middle", F.lit(sign), F.lit(0)))
    between = F.when(named, F.array().cast("array<string>")).otherwise(F.split("middle", sign, -1))
    df = df.withColumns({"signs": signs, "between": between})
    redrawn = F.transform("signs", _replaced)
    spelled = F.array_join(F.zip_with("between", redrawn, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    octets = F.transform(
        F.split("middle", r"\."),
        lambda o, i: F.when(F.col("attempt") >= FORM_DRAWS, F.pmod(_number(i), F.lit(256)))
        .when(F.length(o) == 1, F.pmod(_number(i), F.lit(10)))
        .when(F.length(o) == 2, 10 + F.pmod(_number(i), F.lit(90)))
        .otherwise(100 + F.pmod(_number(i), F.lit(156)))
        .cast("string"),
    )
    middle = F.col("middle")
    letters = F.when(F.col("hexadecimal"), HEX).otherwise(ALPHABETS[1])
    tail = F.transform(
        F.slice(F.sequence(F.lit(0), F.col("added")), F.lit(2), F.col("added")),
        lambda i: F.substring(letters, (F.pmod(_number(F.size("signs") + i - 1), F.length(letters)) + 1).cast("int"), F.lit(1)),
    )
    anew = F.concat(spelled, F.array_join(tail, ""))
    script = F.when(middle.rlike(r"\p{IsCyrillic}"), "cyrillic").when(middle.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    df = df.withColumn("script", script)
    first, last = _name(F.col("script"), F.col("gender"), F.col("attempt"))
    name = F.when(~named, "").when(middle.rlike("[ \u00A0]"), F.concat(first, F.lit(" "), last)).otherwise(last)
    df = df.withColumn("name", name)
    name = F.when(F.upper(middle) == middle, F.upper("name")).otherwise(F.col("name"))
    new = F.when(F.col("kind") == "ip", F.array_join(octets, ".")).when(named, name)
    df = df.withColumn("drawn", F.concat("before", new.otherwise(anew), "after"))  # a column, as check digits need it several times
    checked = _with_check_digits(F.col("kind"), F.col("value"), F.col("drawn"))
    df = df.withColumn("surrogate", F.when(F.col("kind").isin("card", "iban"), checked).otherwise(F.col("drawn")))
    placeholder = F.concat(F.lit("["), "kind", F.lit("-"), F.substring(F.get("stream", F.lit(0)), 1, 16), F.lit("]"))
    df = df.withColumn("surrogate", F.when(F.col("attempt") < 0, placeholder).otherwise(F.col("surrogate")))
    return df.drop("stream", "hexadecimal", "added", "signs", "between", "script", "name", "drawn")


def _draws(values: DataFrame, secret: str) -> DataFrame:
    """``(value, kind, before, middle, surrogate)`` for the distinct values, after as many draws as collisions need."""
    described = materialize(describe(values), "values")
    male, female = F.max((F.col("gender") == "m").cast("int")), F.max((F.col("gender") == "f").cast("int"))
    gender = F.when(male > female, "m").when(female > male, "f").otherwise("n").alias("gender")
    entities = described.groupBy("entity").agg(F.min("value").alias("value"), gender)
    entities = materialize(entities.withColumn("attempt", F.lit(0)), "entities")
    known = entities.select(F.col("entity").alias("new"))
    state = entities
    for _ in range(MOST_DRAWS):
        named = describe(state.withColumnRenamed("gender", "sex").drop("entity")).withColumn("gender", F.col("sex"))
        drawn = with_surrogates(named, secret)
        drawn = drawn.select(F.col("entity").alias("own"), F.col("value").alias("of"), F.col("gender").alias("sex"), "attempt", "surrogate")
        drawn = describe(drawn, "surrogate").select(F.col("own").alias("entity"), F.col("of").alias("value"), F.col("sex").alias("gender"), "attempt", F.col("entity").alias("new"))
        drawn = materialize(drawn, "drawn")
        groups = drawn.groupBy("new").agg(F.min(F.struct("attempt", "entity")).alias("winner"), F.count("*").alias("n"))
        lost = drawn.join(groups.filter("n > 1"), "new").filter(F.struct("attempt", "entity") != F.col("winner"))
        again = lost.select("entity").unionByName(drawn.join(known, "new", "left_semi").select("entity")).distinct()
        again = materialize(again, "again")
        state = drawn.select("entity", "value", "gender", "attempt")
        if again.isEmpty():
            break
        more = state.join(again.withColumn("more", F.lit(1)), "entity", "left")
        state = materialize(more.select("entity", "value", "gender", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
    else:
        state = more.select("entity", "value", "gender", F.when(F.col("more").isNotNull(), -1).otherwise(F.col("attempt")).alias("attempt"))
    final = described.drop("gender").join(state.select("entity", "gender", "attempt"), "entity")
    columns = ["value", "kind", "before", "middle", "surrogate"]
    done = materialize(with_surrogates(final, secret).select(*columns), "surrogates")
    discard(described, entities)
    return done


def _names(mentions: DataFrame) -> DataFrame:
    """``(_mention_row, _alias)``: in each document, the names of its titled persons and what replaces them.

    A full name stands for itself, a surname for the first full name that ends in it, or else for the first
    mention of it.
    """
    space = "[ \u00A0]+"
    tokens, new = F.split("middle", space), F.split(F.substr("surrogate", F.length("before") + 1), " ")
    # A surrogate that is a placeholder stands for all of the name.
    whole = F.when(F.col("surrogate").startswith("["), F.array("surrogate")).otherwise(new)
    persons = mentions.filter("kind = 'person'").select("_mention_row", "_at", tokens.alias("old"), whole.alias("new"))
    last = F.struct(F.element_at("old", -1).alias("of"), F.element_at("new", -1).alias("to"), (F.size("old") == 1).alias("late"))
    full = F.struct(F.array_join("old", " ").alias("of"), F.array_join("new", " ").alias("to"), F.lit(False).alias("late"))
    aliases = F.explode(F.when(F.size("old") > 1, F.array(full, last)).otherwise(F.array(last)))
    rows = persons.select("_mention_row", "_at", aliases.alias("a")).select("_mention_row", "_at", "a.*")
    first = rows.groupBy("_mention_row", "of").agg(F.min(F.struct("late", "_at", "to")).alias("first"))
    pairs = F.map_from_entries(F.collect_list(F.struct("of", "first.to")))
    return first.groupBy(F.col("_mention_row").alias("_named_row")).agg(pairs.alias("_alias"))


def _renamed(gap: Column, alias: Column) -> Column:
    """Text between entities with the names in ``alias`` replaced, all at once."""
    longest = F.array_sort(F.map_keys(alias), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<![\p{L}\d])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\d])"))
    found = F.regexp_extract_all(gap, pattern, F.lit(0))
    new = F.transform(found, lambda x: F.try_element_at(alias, x))
    return F.array_join(F.zip_with(F.split(gap, pattern, -1), new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def replace_personal_data(docs: DataFrame, secret: str, found_column: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced by surrogates; other columns are unchanged.

    ``secret`` is the key of the surrogates: with the same key, tables get the same ones, but for collisions.
    With ``found_column`` the number of entities found by their patterns is added under that name. A null
    text stays null and an empty one empty; texts of any length are searched whole; repeated rows get the same
    result, and of entities that draw the same surrogate the one with fewer draws, then the smaller one, keeps
    it. A form whose choices are all taken grows by letters, or where it cannot, gives way to a placeholder.
    Text outside the entities is kept as it is. Only texts with entities are shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_data = text.rlike(MAY_HOLD) & text.rlike(PATTERN)
    plain = docs.filter(~has_data)
    row, found = fresh(docs.columns, "_row"), fresh(docs.columns, "_found")
    marked = docs.filter(has_data).withColumn(row, F.monotonically_increasing_id())
    marked = materialize(marked.withColumn(found, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), "marked")
    mentions = marked.select(F.col(row).alias("_mention_row"), F.posexplode(found).alias("_at", "value"))
    surrogates = _draws(mentions.select("value").distinct(), secret)
    mentions = mentions.join(surrogates.hint(join_hint(surrogates.count())), "value")
    mentions = materialize(mentions, "mentions")
    one = F.struct("_at", "surrogate", (F.col("kind") == "person").alias("person"), "before", "middle")
    new = mentions.groupBy("_mention_row").agg(F.array_sort(F.collect_list(one)).alias("_new"))
    new = new.join(_names(mentions), F.col("_mention_row") == F.col("_named_row"), "left").drop("_named_row")
    texts = marked.select(F.col(row).alias("_text_row"), F.split("text", PATTERN, -1).alias("_gaps"))
    texts = texts.join(new, F.col("_text_row") == F.col("_mention_row"))
    # A surname after a title is that of the full name in the same document.
    surname = F.transform("_new", lambda x: F.when(
        x["person"] & ~x["surrogate"].startswith("["), F.coalesce(F.concat(x["before"], F.try_element_at("_alias", x["middle"])), x["surrogate"])
    ).otherwise(x["surrogate"]))
    texts = texts.withColumn("_new", F.when(F.col("_alias").isNull(), F.transform("_new", lambda x: x["surrogate"])).otherwise(surname))
    gaps = F.when(F.col("_alias").isNull(), F.col("_gaps")).otherwise(F.transform("_gaps", lambda g: _renamed(g, F.col("_alias"))))
    pieces = F.zip_with(gaps, "_new", lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    rewritten, after = fresh(docs.columns, "_rewritten"), fresh(docs.columns, "_after_row")
    texts = texts.select(F.col("_text_row").alias(after), F.array_join(pieces, "").alias(rewritten))
    joined = marked.join(texts, marked[row] == texts[after])
    columns = [F.col(rewritten).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    counted = [F.size(found).alias(found_column)] if found_column else []
    none = [F.lit(0).alias(found_column)] if found_column else []
    as_text = [F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return plain.select(*as_text, *none).unionByName(joined.select(*columns, *counted))
