"""Personal data replaced by keyed surrogates, in Spark expressions only.

Detected: e-mail addresses (letters of any script), telephone numbers (with a
country code in any grouping; North American and zero-led national ones), card
numbers that pass the Luhn test, United States social security numbers, IBANs
whose check digits hold, IPv4 and IPv6 addresses, and names: after a title or a
phrase that announces one, or before an address in angle brackets; and in a text
with such a name, every other mention of its given or family name.

An entity is normalised (case, punctuation), and a keyed digest of it draws a
surrogate of its type, shape and format:

* e-mail: letters for letters and digits for digits; ``@``, dots and the top-level domain stay;
* telephone, card, social security numbers and IBANs: the mention's own punctuation, country
  code and length stay; card numbers and IBANs keep valid check digits;
* addresses: octets from 1 to 223, hexadecimal digits for such digits;
* names: the title stays; given and family names are drawn apart, each of syllables of its
  script (Latin, Cyrillic, Greek), a female given name ending in that script's vowel, a male one in
  a consonant (gender by a title in the text, else by the name's own ending); capitals follow the mention.

As parts of names have surrogates of their own, ``Mr. John Smith``, ``Mr. Smith``
and ``Smith`` stay one person.  Every mention of an entity gets the same
surrogate, in its own format.  Distinct entities stay distinct: surrogates that
two entities of a type share, or that stand in the corpus as an entity, are drawn
anew (names one syllable longer) until none is left.

Work is dealt by counted repartitions, which adaptive execution does not merge:
drawing is heavy in seconds and small in bytes.

Defined results: null texts stay null, empty ones empty; rows without entities
pass unchanged; null ids and repeated rows are kept; an empty table gives no
rows; further columns are ignored by :func:`pseudonymise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, scratch

# Titles by gender, phrases before a name, and telephone codes of countries.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος", "Sir"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"),
    "u": ("Dr", "Prof", "Professor", "Doctor"),
}
CUES = ("My name is", "my name is", "Name:", "name:", "Dear", "Sincerely,", "sincerely,", "Regards,", "regards,", "Signed,", "Mein Name ist", "mein Name ist", "ich heiße", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "mi nombre es", "Меня зовут", "меня зовут")
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# The patterns of the entity types, in the order they are tried, each at the start of a word.
EMAIL = r"(?<![.%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![.-])(?<!ersion )(?<!uild ){OCTET}(?:\.{OCTET}){{3}}(?!\w|[.-]\d)"
IPV6 = r"(?<!:)(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
CARD = r"(?<![.+-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\w)"
SSN = r"(?<![.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
PHONE = (
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\+(?!1[^\d])\d(?:[ ./()-]{0,2}\d){6,14}(?!\w)"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![.+-])0\d(?:[ .]\d{2}){4}(?!\w)|(?<![.+-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?!\w)"
)
WORD = r"\p{Lu}\p{L}*+(?:['-]\p{Lu}\p{L}++)*+"
TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\.? "
NAME = rf"{TITLE}(?:{WORD} (?:\p{{Lu}}\. )?)?{WORD}|(?<=(?:{'|'.join(CUES)}) ){WORD}(?: {WORD})?|{WORD} {WORD}(?= <[^<>@\s]{{1,64}}@)"
START, STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ENTITY = START + "(?:" + "|".join((EMAIL, IBAN, IPV6, IPV4, CARD, SSN, PHONE, NAME)) + ")"

#: Syllables of names by script: consonants, vowels, endings of female and male given names.
SCRIPTS = {"latin": ("bdfgklmnprstvz", "aeiou", "a", "n"), "cyrillic": ("бвгдклмнпрстхз", "аеиоу", "а", "н"), "greek": ("βγδκλμνπρστφχζ", "αειου", "α", "ς")}

#: Entities or mentions that one task works on, on average.
TASK_ROWS = 500

PART = "struct<kind:string,normal:string,at:int>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def kind_of(mention: Column) -> Column:
    """Type of a mention; null for what only looks like a card number or IBAN."""
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    card = F.when(_luhn_ok(_strip(mention)), F.lit("card"))
    return (
        F.when(F.instr(mention, "@") > 0, "email")
        .when(mention.rlike(r"^[A-Z]{2}\d\d"), F.when(_iban_ok(_strip(mention)), F.lit("iban")))
        .when(F.instr(mention, ":") > 0, "ipv6")
        .when(mention.rlike(r"^\d+(?:\.\d+){3}$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\p{L}"), "name")
        .when(mention.rlike(r"^\d") & (digits >= 13), card)
        .otherwise("phone")
    )


def normal_form(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(mention))
        .when(kind == "phone", F.when(mention.startswith("+"), F.concat(F.lit("+"), digits)).when(digits.startswith("0"), digits).otherwise(F.concat(F.lit("+1"), digits)))
        .when(kind == "ip", mention)
        .otherwise(F.upper(_strip(mention)))
    )


def _name_words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, "^" + TITLE, ""), " ")


def _title_gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, "^(" + TITLE + ")", 1)
    title = F.regexp_replace(title, r"\.? $", "")
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("u")


def _name_roles(mention: Column) -> Column:
    """array<struct<role, word>> of a mention found by a pattern: family last, given names before, initials left out."""
    words, gender = _name_words(mention), _title_gender(mention)
    roles = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("family")).otherwise(F.concat(F.lit("given_"), gender)).alias("role"), w.alias("word")))
    return F.filter(roles, lambda r: ~r["word"].endswith("."))


def _given(known: Column, word: Column) -> Column:
    """Role of a given name: by a titled mention in the text, else by its ending."""
    low = F.lower(word)
    titled = F.array_sort(F.filter(known, lambda k: (F.lower(k["word"]) == low) & k["role"].isin("given_f", "given_m")))
    return F.when(F.size(titled) > 0, titled[0]["role"]).when(low.rlike("[aeаеяαεη]$"), F.lit("given_f")).otherwise(F.lit("given_m"))


def _parts(mention: Column, known: Column) -> Column:
    """array<struct<kind, normal, at>>: what of a mention has a surrogate of its own, ``at`` being the word's place in a name."""
    kind = kind_of(mention)
    words = _name_words(mention)
    family = lambda w: F.exists(known, lambda k: (k["role"] == "family") & (F.lower(k["word"]) == F.lower(w)))
    role = lambda w, i: F.when(i < F.size(words) - 1, _given(known, w)).when((F.size(words) > 1) | family(w), F.lit("family")).otherwise(_given(known, w))
    named = F.filter(F.transform(words, lambda w, i: F.struct(role(w, i).alias("kind"), F.lower(w).alias("normal"), i.cast("int").alias("at"))), lambda p: ~p["normal"].endswith("."))
    none = F.expr(f"cast(array() as array<{PART}>)")
    return F.when(kind.isNull(), none).when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), normal_form(kind, mention).alias("normal"), F.lit(0).alias("at"))))


def _digest(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """64 hex characters that key, entity and attempt fix (an inner and an outer hash, as in HMAC)."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string")), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _draw(hex_: Column, i: Column, below: int) -> Column:
    """Number i of a stream of draws below ``below``: the digest is hashed again every eight draws."""
    block = F.when(i < 8, hex_).otherwise(F.sha2(F.concat(hex_, F.floor(i / 8).cast("string")), 256))
    return F.pmod(F.conv(F.substring(block, F.pmod(i, F.lit(8)).cast("int") * 8 + 1, 8), 16, 10).cast("long"), F.lit(below))


def _pick(hex_: Column, i: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), (_draw(hex_, i, len(letters)) + 1).cast("int"), 1)


_AZ, _09 = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _shape(hex_: Column, text: Column) -> Column:
    """Letters for letters, digits for digits; the rest stays."""
    return F.array_join(
        F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(hex_, i, _AZ))).when(c.rlike(r"\p{L}"), _pick(hex_, i, _AZ)).when(c.rlike(r"\p{N}"), _pick(hex_, i, _09)).otherwise(c)),
        "",
    )


def _digits(hex_: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(hex_, i, _09)), "")


def _luhn(body: Column) -> Column:
    """Check digit of a number without one; the last digit of ``body`` is doubled."""
    n = F.length(body)
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.when(F.pmod(n - i, F.lit(2)) == 0, F.element_at(doubled, F.substring(body, i, 1).cast("int") + 1)).otherwise(F.substring(body, i, 1).cast("int")),
    )
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _luhn_ok(number: Column) -> Column:
    return _luhn(F.substring(number, F.lit(1), F.length(number) - 1)) == F.substring(number, -1, 1)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters (A is 10), read as one number."""
    code = lambda c: F.ascii(c)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.pmod(F.when(code(c) >= 65, r * 100 + code(c) - 55).otherwise(r * 10 + code(c) - 48), F.lit(97)))


def _iban_ok(iban: Column) -> Column:
    return _mod97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))) == 1


def _name(hex_: Column, kind: Column, normal: Column, attempt: Column) -> Column:
    """Drawn name of the script of ``normal``, in lower case."""
    cyrillic, greek = normal.rlike(r"\p{IsCyrillic}"), normal.rlike(r"\p{IsGreek}")

    def drawn(script: str) -> Column:
        consonants, vowels, a, n = SCRIPTS[script]
        syllables = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda j: F.concat(_pick(hex_, j * 2, consonants), _pick(hex_, j * 2 + 1, vowels))), "")
        return F.concat(syllables, F.when(kind == "given_f", F.lit(consonants[3] + a)).when(kind == "given_m", F.lit(n)).otherwise(F.lit(consonants[6])))

    return F.when(cyrillic, drawn("cyrillic")).when(greek, drawn("greek")).otherwise(drawn("latin"))


def surrogate_form(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """Surrogate of a normal form, itself a normal form of the same type."""
    h = _digest(key, kind, normal, attempt)
    n = F.length(normal)
    top = F.substring_index(normal, ".", -1)
    body = F.concat(F.substring(normal, 1, 1), _digits(h, n - 2))
    code = F.when(normal.startswith("+"), F.regexp_extract(normal, "^" + COUNTRY, 0)).otherwise(F.substring(normal, 1, 1))
    number = F.concat(code, F.element_at(F.split(F.lit("23456789"), ""), (_draw(h, F.lit(31), 8) + 1).cast("int")), _digits(h, n - F.length(code) - 1))
    ssn = F.concat((_draw(h, F.lit(0), 566) + 100).cast("string"), F.lpad((_draw(h, F.lit(1), 99) + 1).cast("string"), 2, "0"), F.lpad((_draw(h, F.lit(2), 9999) + 1).cast("string"), 4, "0"))
    account = F.upper(_shape(h, F.substring(normal, F.lit(5), n - 4)))
    check = F.lpad((98 - _mod97(F.concat(account, F.substring(normal, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    hexes = F.array_join(F.transform(F.split(normal, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick(h, i, "0123456789abcdef")).otherwise(c)), "")
    return (
        F.when(kind == "email", F.concat(_shape(h, F.substring(normal, F.lit(1), n - F.length(top) - 1)), F.lit("."), top))
        .when(kind == "phone", number)
        .when(kind == "card", F.concat(body, _luhn(body)))
        .when(kind == "ssn", ssn)
        .when(kind == "iban", F.concat(F.substring(normal, 1, 2), check, account))
        .when(kind == "ip", F.concat_ws(".", *[(_draw(h, F.lit(i), 223) + 1).cast("string") for i in range(4)]))
        .when(kind == "ipv6", hexes)
        .otherwise(_name(h, kind, normal, attempt))
    )


def _fill(format_: Column, chars: Column) -> Column:
    """``format_`` with its letters and digits replaced by ``chars``, the last by the last; no mention is longer than some forty characters."""
    alnum = r"[\p{L}\p{N}]"
    return F.aggregate(
        F.split(format_, ""),
        F.struct(F.lit("").alias("out"), (F.length(chars) - F.length(_strip(format_))).alias("k")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(alnum), F.substring(chars, s["k"] + 1, 1)).otherwise(c)).alias("out"),
            (s["k"] + F.when(c.rlike(alnum), 1).otherwise(0)).alias("k"),
        ),
        lambda s: s["out"],
    )


def render(mention: Column, forms: Column) -> Column:
    """A mention's replacement from ``forms`` (array<struct<at, kind, form>>), in the mention's own format; without forms the mention itself."""
    kind, form = forms[0]["kind"], forms[0]["form"]
    words = _name_words(mention)

    def word(w: Column, i: Column) -> Column:
        f = F.filter(forms, lambda x: x["at"] == i)[0]["form"]
        return F.when(f.isNull(), w).when((F.upper(w) == w) & (F.length(w) > 1), F.upper(f)).otherwise(F.concat(F.upper(F.substring(f, 1, 1)), F.substring(f, F.lit(2), F.length(f))))

    named = F.concat(F.regexp_extract(mention, "^(" + TITLE + ")?", 0), F.array_join(F.transform(words, word), " "))
    return (
        F.when(F.size(forms) == 0, mention)
        .when(kind.isin("email", "ipv6"), F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(form)).otherwise(form))
        .when(kind.isin("phone", "card", "ssn", "iban"), _fill(mention, _strip(form)))
        .when(kind == "ip", form)
        .otherwise(named)
    )


def _tasks(df: DataFrame) -> int:
    return max(1, -(-df.count() // TASK_ROWS))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, form) of distinct entities (kind, normal): no two forms of a kind are equal, and none is a normal form."""
    known = Stored(entities.select("kind", "normal").distinct().withColumn("attempt", F.lit(0)), "pii-entities").df
    tasks = _tasks(known)
    form = surrogate_form(key, F.col("kind"), F.col("normal"), F.col("attempt"))
    drawn = Stored(known.repartition(tasks, "kind", "normal").withColumn("form", form), "pii-drawn").df
    while True:
        # of the entities that share a surrogate, the one that had it longest keeps it
        place = Window.partitionBy("kind", "form").orderBy("attempt", "normal")
        real = known.select(F.col("kind").alias("k"), F.col("normal").alias("n"))
        judged = drawn.withColumn("place", F.row_number().over(place)).join(real, (F.col("kind") == F.col("k")) & (F.col("form") == F.col("n")), "left")
        judged = judged.select("kind", "normal", "attempt", "form", ((F.col("place") > 1) | F.col("n").isNotNull()).alias("bad"))
        judged = Stored(judged, "pii-judged").df
        if not judged.where("bad").limit(1).count():
            return judged.select("kind", "normal", "form")
        again = judged.where("bad").withColumn("attempt", F.col("attempt") + 1).repartition(tasks, "kind", "normal").withColumn("form", form)
        drawn = Stored(judged.where("not bad").unionByName(again).drop("bad"), "pii-drawn").df


def _pattern(bare: Column) -> Column:
    """The entity pattern, and for texts with names those names wherever they stand."""
    return F.when(F.size(bare) > 0, F.concat(F.lit(f"{ENTITY}|{START}(?:"), F.array_join(bare, "|"), F.lit(f"){STOP}"))).otherwise(F.lit(ENTITY))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mentions, known, bare) of every row: mentions in order, and the names that they hold."""
    found = docs.select("doc_id", "text").withColumn("mentions", F.coalesce(F.regexp_extract_all("text", F.lit(ENTITY), 0), F.array().cast("array<string>")))
    names = F.filter("mentions", lambda m: kind_of(m) == "name")
    known = F.array_distinct(F.flatten(F.transform(names, _name_roles)))
    found = found.withColumn("known", F.when(F.size("mentions") > 0, known).otherwise(F.expr("cast(array() as array<struct<role:string,word:string>>)")))
    words = F.filter(F.transform("known", lambda k: k["word"]), lambda w: F.length(w) > 1)
    found = found.withColumn("bare", F.array_distinct(F.concat(words, F.transform(words, lambda w: F.upper(w)))))
    more = F.when(F.size("bare") > 0, F.regexp_extract_all("text", _pattern(F.col("bare")), 0)).otherwise(F.col("mentions"))
    return found.withColumn("mentions", more).withColumn("key", F.when(F.size("mentions") > 0, F.md5("text")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, kinds): every row with its entities replaced."""
    rows = Stored(scan(docs), "pii-rows").df
    held = rows.where(F.size("mentions") > 0)
    with scratch() as kept:
        # texts that are equal have equal mentions, whatever their ids
        texts = held.select("key", "mentions", "known").groupBy("key").agg(F.first("mentions").alias("mentions"), F.first("known").alias("known"))
        texts = texts.select("key", "known", F.posexplode("mentions").alias("p", "mention"))
        mentions = Stored(texts.select("key", "p", "mention", _parts(F.col("mention"), F.col("known")).alias("parts")), "pii-mentions").df
        part = mentions.select("key", "p", "mention", F.explode_outer("parts").alias("part")).select("key", "p", "mention", "part.kind", "part.normal", "part.at")
        forms = surrogates(part.where(F.col("kind").isNotNull()), key)
        drawn = part.join(forms, ["kind", "normal"], "left").repartition(_tasks(mentions), "key")
        each = drawn.groupBy("key", "p", "mention").agg(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("at", "kind", "form"))).alias("forms"))
        kind = F.when(F.size("forms") > 0, F.when(F.col("forms")[0]["kind"].rlike("^(?:family|given)"), F.lit("name")).otherwise(F.col("forms")[0]["kind"]))
        each = each.select("key", "p", render(F.col("mention"), F.array_sort("forms")).alias("to"), kind.alias("kind"))
        # stored, so that a text of which there are a great many copies can be split in the join
        lists = Stored(each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "to", "kind"))).alias("put")), "pii-lists").df
        kept.append(lists)
    joined = held.join(lists, "key")
    pieces = F.split("text", _pattern(F.col("bare")), -1)
    text = F.concat(F.array_join(F.zip_with(F.slice("pieces", 1, F.size("put")), "put", lambda p, s: F.concat(p, s["to"])), ""), F.element_at("pieces", -1))
    kinds = F.filter(F.transform("put", lambda s: s["kind"]), lambda k: k.isNotNull())
    changed = joined.withColumn("pieces", pieces).select("doc_id", text.alias("text"), F.size(kinds).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))
    other = rows.where(F.size("mentions") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return changed.unionByName(other)
