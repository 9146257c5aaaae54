"""Keyed surrogates for personal data, in DataFrame functions only.

One pass over the texts finds entities by pattern and, in texts that name a person, every other
mention of that person's full or family name.  What is found is written with the texts between, and
texts aren't searched again.

Each distinct entity of a type gets a surrogate that a keyed hash derives from it: digits for digits
and letters for letters, dates by a keyed permutation of days, given names by gender and script,
family names by script.  Names are replaced part by part, so that "Mr John Smith", "John Smith" and
"Smith" read the same person everywhere.  The table of distinct entities is checked: surrogates that
two entities share, or that are themselves entities of the corpus, are derived again until none is
left.  So different entities stay different, and the same entity, in whatever format or case, reads
the same everywhere.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.llm.shared import free_name, small, written

TITLES = {
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "господин"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "госпожа"],
    "any": ["Dr", "Prof"],
}
#: Given names that mark a person without a title, and the first choice of surrogates.
FIRST_NAMES = {
    "male": "James John Robert Michael William David Thomas Daniel Paul Mark Peter George Edward Henry Andrew Steven Kevin Brian Hans Jürgen Klaus Stefan Wolfgang Dieter Pierre Jean Luc Antoine Philippe Carlos José Miguel Javier Pablo Francisco Alejandro".split(),
    "female": "Mary Anna Linda Susan Karen Nancy Sarah Emma Laura Julia Elizabeth Margaret Barbara Jennifer Jessica Emily Petra Monika Sabine Claire Sophie Marie Camille Brigitte Lucía Carmen Elena Isabel Teresa Pilar Rosa Cristina Dolores Mercedes Ursula Heike".split(),
}
LAST_NAMES = "Smith Johnson Brown Miller Davis Wilson Moore Taylor Anderson Harris Müller Schmidt Fischer Weber Wagner Becker Hoffmann Dubois Moreau Laurent Lefebvre Girard García Martínez López Sánchez Romero Torres Navarro Molina".split()
CYRILLIC = {
    "male": ["Иван", "Пётр", "Сергей", "Алексей", "Николай", "Павел", "Дмитрий", "Олег"],
    "female": ["Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья", "Ирина", "Вера"],
    "last": ["Соколенко", "Бондаренко", "Коваленко", "Шевченко", "Черных", "Седых", "Петренко", "Ткаченко"],
}
#: Syllables of made names, by script; a name takes one more every second attempt.
SYLLABLES = {
    "latin": "ba ber bran cal cor da den dor el fen gar hal hol ka kel lan lor mar mel mon na nor pel ran ros sel sten tal tor val van wil".split(),
    "cyrillic": "ба бер вал гор дан дор ел жар зо кар ков лан лев мар мен мир на нов ол пет рад рос сан сел тан тор фед хар чер шан яр юр".split(),
    "greek": "αν βα γα δη ελ ζω θε ιο κα λα μα νι ξε ο πα ρα σα τα υα φι χα ψα ωρ".split(),
}
STREETS = "street st road rd avenue ave lane ln drive boulevard blvd court square way place rue calle avenida plaza de la".split()
_STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way|Place"
_WEG = "straße|strasse|weg|platz|gasse|allee"

_TITLE = "|".join(t for kind in TITLES.values() for t in kind)
_GIVEN = "|".join([*FIRST_NAMES["male"], *FIRST_NAMES["female"], *CYRILLIC["male"], *CYRILLIC["female"]])
#: Capitalised words that stand behind a name without being part of it.
NOT_NAMES = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag "
    "January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember "
    "The This That He She It They We You I In On At But And Is Was Then There When What Who How Why Yes No Please Thanks Der Die Das Er Sie Es Wir Ihr Und Aber Le La Les Il Elle El Los Las"
).split()
#: Names that are everyday words too, or places: behind a title or a given name alone do they tell a person.
ALSO_WORDS = [*NOT_NAMES, *"Will Can Bill Grant Hope Joy Grace Faith Young Long King Church Day Park Paris London Berlin Madrid".split()]
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?(?![\p{L}])"
_NEXT = rf"(?!(?:{'|'.join(NOT_NAMES)})(?![\p{{L}}])){_WORD}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Type -> pattern, each behind neither a letter nor a digit; where several match, the first does.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,20}[A-Za-z]{2,63}(?![\p{L}\p{N}])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ip6": rf"(?<!:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:(?:{_HEX}:){{2,6}}|[fF][eE]80:):(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\d:])",
    "account": r"(?:\d{13,19}|\d{4}(?:\x20\d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}\x20\d{6}\x20\d{5})(?![\p{L}\d])",
    "iban": r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\d-])",
    "date": r"(?=\d)(?<=(?i:born|born on|dob|date of birth|birthday|geboren am|né le|née le|nacido el|nacida el)[\x20:]{1,2})(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?<d>[./-])\d{1,2}\k<d>\d{4})(?![\p{L}\d])",
    "phone": (
        r"(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]\d{3,4}|\d{2,4}(?<s>[\x20.-])\d{3,4}\k<s>\d{3,4})(?![\p{L}\d])|\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,5}(?![\p{L}\d])"
        r"|(?=\d)(?<=(?i:tel|phone|call|fax|mobile)[.:]{0,1}\x20)\d{3}[.-]\d{4}(?![\p{L}\d-])"
    ),
    "address": (
        rf"\d{{1,5}}[A-Za-z]?\x20(?:\p{{Lu}}\p{{Ll}}+\x20){{1,3}}(?:{_STREET})(?![\p{{L}}])|\p{{Lu}}\p{{Ll}}+(?:{_WEG})\x20\d{{1,4}}[a-z]?(?![\p{{L}}\d])"
        r"|\d{1,4},?\x20(?:rue|avenue|boulevard|place)\x20(?:de\x20(?:la\x20)?)?\p{Lu}\p{Ll}+(?![\p{L}])|(?:Calle|Avenida|Plaza)\x20(?:de\x20)?\p{Lu}\p{Ll}+,?\x20\d{1,4}(?![\p{L}\d])"
    ),
    "person": rf"(?=\p{{Lu}}|г)(?:(?:{_TITLE})\.?\x20{_WORD}(?:\x20{_NEXT})?|(?:{_GIVEN})\x20{_NEXT})",
}
_ORDER = list(PATTERNS)
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'(?:{PATTERNS[t]})' for t in _ORDER)})"
ROUNDS = 20
#: Copies of each form among which rows are dealt out when forms are too many to broadcast.
SALTS = 16


def _spelled(entity: Column) -> Column:
    """A person's words without the title."""
    return F.split(F.regexp_replace(entity, rf"^(?:{_TITLE})\.?\x20", ""), " ")


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the entity is; a date is known by its form, since its marker stands before it."""
    kind = F.lit("person")
    for t in reversed(_ORDER[:-1]):
        pattern = {"date": r"\d{4}-\d{2}-\d{2}|\d{1,2}(?<d>[./-])\d{1,2}\k<d>\d{4}", "phone": PATTERNS["phone"].split("|(?=")[0] + r"|\d{3}[.-]\d{4}"}.get(t, PATTERNS[t])
        kind = F.when(entity.rlike(rf"^(?:{pattern})$"), F.lit(t)).otherwise(kind)
    return kind


def search_pattern(found: Column, text: Column) -> Column:
    """ENTITY, and the names of the persons among the entities found: family names, alone or behind a given name found with one.

    A name that is an everyday word, or that the text has in lower case too, isn't looked for on its own.
    """
    words = F.transform(F.filter(found, lambda e: e.rlike(rf"^(?:{PATTERNS['person']})$")), _spelled)
    last = F.array_distinct(F.transform(words, lambda w: F.element_at(w, -1)))
    plain = F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(last, F.lower), "|"), F.lit(r")(?![\p{L}])")), F.lit(0)))
    last = F.filter(last, lambda w: ~w.isin(ALSO_WORDS) & ~F.array_contains(plain, F.lower(w)))
    first = F.array_distinct(F.transform(F.filter(words, lambda w: F.size(w) > 1), lambda w: w[0]))
    given = F.when(F.size(first) > 0, F.concat(F.lit("(?:(?:"), F.array_join(first, "|"), F.lit(r")\x20)?"))).otherwise("")
    mention = F.concat(F.lit(rf"{ENTITY}|(?<![\p{{L}}\p{{N}}]){{0}}".replace("{0}", "")), given, F.lit("(?:"), F.array_join(last, "|"), F.lit(r")(?![\p{L}])"))
    return F.when(F.size(last) > 0, mention)


def _date(entity: Column) -> Column:
    """The day that a birth date names: day first, unless only month first is a date; null if none is."""
    d = F.regexp_replace(entity, "[./]", "-")
    return F.coalesce(F.try_to_date(d, "yyyy-MM-dd"), F.try_to_date(d, "d-M-yyyy"), F.try_to_date(d, "M-d-yyyy"))


def canonical(kind: Column, entity: Column) -> Column:
    """What spellings of one entity share: its digits, its day, or its text in lower case."""
    return (
        F.when(kind.isin("phone", "ssn", "account"), F.regexp_replace(entity, r"[^0-9]", ""))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "date", F.coalesce(_date(entity).cast("string"), entity))
        .otherwise(F.lower(entity))
    )


def gender_of(entity: Column) -> Column:
    """By title, then by a known given name; 'any' if neither tells."""
    title, first = F.regexp_extract(entity, rf"^({_TITLE})\.?\x20", 1), _spelled(entity)[0]
    return (
        F.when(title.isin(TITLES["male"]), "male").when(title.isin(TITLES["female"]), "female")
        .when(first.isin([*FIRST_NAMES["male"], *CYRILLIC["male"]]), "male").when(first.isin([*FIRST_NAMES["female"], *CYRILLIC["female"]]), "female")
        .otherwise("any")
    )


def _byte(digest: Column, i: Column | int) -> Column:
    """Number of the i-th pair of hex digits, round and round."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(32)) * 2 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _reshaped(text: Column, digest: Column) -> Column:
    """text with each digit and ASCII letter, or letter of another alphabet, replaced; what isn't either stays."""
    letters, cyrillic = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("абвгдежзиклмнопрстуфхцчшэюя")

    def other(c: Column, i: Column) -> Column:
        b = _byte(digest, i) + F.shiftright(i, 5)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.substring(cyrillic, F.pmod(b, F.lit(27)) + 1, F.lit(1)))
            .when(c.rlike(r"\p{Lu}"), F.upper(F.substring(letters, F.pmod(b, F.lit(26)) + 1, F.lit(1))))
            .when(c.rlike(r"\p{L}"), F.substring(letters, F.pmod(b, F.lit(26)) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(F.pmod(i, F.lit(2)) == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add), F.lit(10))


def _pick(names: list[str], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(b, F.lit(len(names))) + 1)


def _made_name(script: Column, digest: Column, attempt: Column) -> Column:
    """Two syllables of the script, and one more every second attempt."""
    one = lambda i: F.when(script == "cyrillic", _pick(SYLLABLES["cyrillic"], _byte(digest, i))).when(script == "greek", _pick(SYLLABLES["greek"], _byte(digest, i))).otherwise(_pick(SYLLABLES["latin"], _byte(digest, i)))
    return F.array_join(F.transform(F.sequence(F.lit(4), F.lit(5) + F.shiftright(attempt, 1)), one), "")


def surrogate(kind: Column, value: Column, detail: Column, key: str, attempt: Column) -> Column:
    """Surrogate of a canonical value; detail is a given name's gender."""
    digest = F.sha2(F.concat_ws("\0", F.lit(key), kind, value, attempt.cast("string")), 256)
    domain = F.sha2(F.concat_ws("\0", F.lit(key), F.substring_index(value, "@", -1)), 256)
    email = F.concat(_reshaped(F.substring_index(value, "@", 1), digest), F.lit("@"), _reshaped(F.regexp_extract(value, r"@(.*)\.[^.]*$", 1), domain), F.regexp_extract(value, r"(\.[^.]*)$", 1))
    ip = F.concat_ws(".", *[(F.pmod(_byte(digest, i), F.lit(223)) + 1).cast("string") for i in range(4)])
    ip6 = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex((F.pmod(_byte(digest, i), F.lit(15)) + 1).cast("int")))).otherwise(c)), "")
    account = _reshaped(value, digest)
    body = F.substring(account, F.lit(1), F.length(account) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    account = F.when(_luhn(value) == 0, F.concat(body, check)).otherwise(account)
    # Days are permuted in stretches of a prime number of them (179 years), by a keyed line modulo that prime.
    prime, seed = 65537, hashlib.sha256(key.encode()).digest()
    a, b = 2 + int.from_bytes(seed[:4], "big") % (prime - 2), int.from_bytes(seed[4:8], "big") % prime
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1850-01-01").cast("date")).cast("long")
    moved = F.floor(day / prime) * prime + F.pmod(F.pmod(day, F.lit(prime)) * a + b, F.lit(prime))
    date = F.coalesce(F.date_add(F.lit("1850-01-01").cast("date"), moved.cast("int")).cast("string"), _reshaped(value, digest))
    n = [F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int") for i in range(3)]
    male = F.when(detail == "any", F.pmod(n[2], F.lit(2)) == 0).otherwise(detail == "male")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    made = _made_name(script, digest, attempt)
    given = F.when((attempt < 3) & (script != "greek"), F.when(male & (script == "latin"), _pick(FIRST_NAMES["male"], n[0])).when(male, _pick(CYRILLIC["male"], n[0])).when(script == "latin", _pick(FIRST_NAMES["female"], n[0])).otherwise(_pick(CYRILLIC["female"], n[0])))
    given = F.coalesce(given, F.concat(made, F.when(male, F.when(script == "greek", "ος").when(script == "cyrillic", "ий").otherwise("o")).otherwise(F.when(script == "latin", "a").when(script == "greek", "α").otherwise("ия"))))
    family = F.coalesce(F.when((attempt < 2) & (script != "greek"), F.when(script == "latin", _pick(LAST_NAMES, n[1])).otherwise(_pick(CYRILLIC["last"], n[1]))), made)
    # A street keeps its kind; its number and its names change.
    street = lambda w: (
        F.when(w.isin(STREETS), w).when(w.rlike("[0-9]"), _reshaped(w, digest))
        .otherwise(F.concat(_made_name(F.lit("latin"), F.sha2(F.concat(digest, w), 256), attempt), F.regexp_extract(w, rf"((?:{_WEG})?,?)$", 1)))
    )
    address = F.array_join(F.transform(F.split(value, " "), street), " ")
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "account", account).when(kind == "date", date)
        .when(kind == "given", F.lower(given)).when(kind == "family", F.lower(family)).when(kind == "address", address).otherwise(_reshaped(value, digest))
    )


def in_format(kind: Column, entity: Column, value: Column) -> Column:
    """A surrogate value in the format of the entity that it replaces: separators, country code and case.  Persons are made of parts elsewhere."""
    keep = F.when(kind == "phone", F.length(F.regexp_replace(F.regexp_extract(entity, r"^\+(\d{1,3})(?=[^\d])", 1), r"[^0-9]", ""))).otherwise(F.lit(0))

    def fill(state: Column, c: Column) -> Column:
        taken = c.rlike("[0-9A-Za-z]")
        new = F.when(state["n"] < keep, c).otherwise(F.substring(value, state["n"] + 1, F.lit(1)))
        return F.struct(F.concat(state["out"], F.when(taken, new).otherwise(c)).alias("out"), (state["n"] + taken.cast("int")).alias("n"))

    filled = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), fill)["out"]
    case = F.when(entity == F.upper(entity), F.upper(value)).otherwise(value)
    sep = F.regexp_extract(entity, r"([./-])\d{4}$", 1)
    day = F.try_to_date(value, "yyyy-MM-dd")
    date = F.when((sep == "") | day.isNull(), value).when(entity.rlike(r"^\d{2}\D\d{2}\D"), F.replace(F.date_format(day, "dd-MM-yyyy"), F.lit("-"), sep)).otherwise(F.replace(F.date_format(day, "d-M-yyyy"), F.lit("-"), sep))
    street = F.array_join(F.zip_with(F.split(entity, " "), F.split(value, " "), lambda old, new: F.when(old == F.lower(old), new).otherwise(F.initcap(new))), " ")
    return F.when(kind.isin("email", "ip6"), case).when(kind == "ip", value).when(kind == "date", date).when(kind == "address", street).otherwise(filled)


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct entities of found (kind, value, detail), no surrogate twice and none an entity.

    An entity whose surrogate another holds, or that is an entity itself, takes its next one; the
    holder with the fewest attempts, then the smallest value, stays.  A known gender goes before
    'any'.  Days are permuted, and so may be days of the corpus.  What still collides after ROUNDS,
    as where a corpus holds nearly all numbers of a format, takes its type and a keyed hash.
    """
    parts = found.sparkSession.sparkContext.defaultParallelism
    own = written(found.groupBy("kind", "value").agg(F.max("detail").alias("detail")).repartition(parts, "kind", "value"))
    taken = own.where("kind <> 'date'").select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    now, settled = own.withColumn("attempt", F.lit(0)).withColumn("made", F.lit(None).cast("string")), None
    for _ in range(ROUNDS):
        made = now.withColumn("surrogate", F.coalesce("made", surrogate(F.col("kind"), F.col("value"), F.col("detail"), key, F.col("attempt"))))
        made = written(made.repartition(parts, "kind", "value"))
        first = made.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = made.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        again = (F.col("first.value") != F.col("value")) | F.coalesce("real", F.lit(False))
        judged = written(judged.select("kind", "value", "detail", "attempt", "surrogate", again.alias("again")))
        if judged.where("again").isEmpty():
            return judged.select("kind", "value", "surrogate")
        now = judged.select("kind", "value", "detail", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), F.when(~F.col("again"), F.col("surrogate")).alias("made"))
        settled = judged
    last = F.concat_ws("-", F.col("kind"), F.substring(F.sha2(F.concat_ws("\0", F.lit(key), "kind", "value"), 256), 1, 24))
    return settled.select("kind", "value", F.when(F.col("again"), last).otherwise(F.col("surrogate")).alias("surrogate"))


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """(entity, kind, new) of distinct entities (entity); persons are put together from their parts' surrogates."""
    forms = written(entities.withColumn("kind", kind_of(F.col("entity"))).repartition(entities.sparkSession.sparkContext.defaultParallelism, "entity"))
    words = _spelled(F.col("entity"))
    person = F.array(
        F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(words, -1)).alias("value"), F.lit("").alias("detail")),
        F.struct(F.lit("given").alias("kind"), F.when(F.size(words) > 1, F.lower(words[0])).alias("value"), gender_of(F.col("entity")).alias("detail")),
    )
    plain = F.array(F.struct("kind", canonical(F.col("kind"), F.col("entity")).alias("value"), F.lit("").alias("detail")))
    parts = forms.select(F.explode(F.when(F.col("kind") == "person", person).otherwise(plain)).alias("x")).select("x.*").where("value IS NOT NULL")
    made = small(written(surrogate_table(parts, key)))
    of = lambda kind: made.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("surrogate").alias(f"new_{kind}"))
    who = forms.where("kind = 'person'").withColumn("family", F.lower(F.element_at(words, -1))).withColumn("given", F.when(F.size(words) > 1, F.lower(words[0])))
    who = who.join(of("family"), "family").join(of("given"), "given", "left")
    title = F.regexp_extract("entity", rf"^((?:{_TITLE})\.?\x20)", 1)
    who = who.select("entity", "kind", F.concat(title, F.coalesce(F.concat(F.initcap("new_given"), F.lit(" ")), F.lit("")), F.initcap("new_family")).alias("new"))
    rest = forms.where("kind <> 'person'").withColumn("value", canonical(F.col("kind"), F.col("entity"))).join(made, ["kind", "value"])
    hashed = F.startswith("surrogate", F.concat("kind", F.lit("-")))
    return who.unionByName(rest.select("entity", "kind", F.when(hashed, F.col("surrogate")).otherwise(in_format(F.col("kind"), F.col("entity"), F.col("surrogate"))).alias("new")))


def with_surrogates(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities replaced in text_col, and the added columns n_entities (long) and entity_kinds (sorted, distinct).

    The same key gives the same surrogates for the same corpus.  Rows without entities, null and
    empty texts come through unchanged, with 0 entities.  Repeated rows give repeated results; null
    ids are allowed; other columns pass unchanged, but for those named like an added one, which are
    replaced; an empty table gives an empty result.

    A person is known by a title or by a given name of FIRST_NAMES; from then on the full name and
    the family name are replaced wherever they stand in that text; a family name that is an everyday word (ALSO_WORDS), or that
    stands in the text in lower case too, only behind a title or a given name.  A domain has at most 20 labels before its last.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_entities", "entity_kinds")])
    text, ents, row, parts = F.col(f"`{text_col}`"), free_name(docs, "entities"), free_name(docs, "row_key"), free_name(docs, "text_parts")
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    pattern = free_name(docs, "entity_pattern")
    marked = docs.withColumn(ents, found).withColumn(pattern, F.when(F.size(ents) > 0, F.coalesce(search_pattern(F.col(ents), text), F.lit(ENTITY))))
    several = F.when(F.col(pattern) == ENTITY, F.col(ents)).otherwise(F.regexp_extract_all(text, F.col(pattern), F.lit(0)))
    marked = marked.withColumns({row: F.monotonically_increasing_id(), ents: F.when(F.col(pattern).isNotNull(), several), parts: F.when(F.col(pattern).isNotNull(), F.split(text, F.col(pattern), -1))}).drop(pattern)
    marked = written(marked)
    plain = marked.where(F.col(ents).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_kinds"))
    hits = marked.where(F.col(ents).isNotNull())
    pairs = written(hits.select(F.col(row).alias("row"), F.explode(F.array_distinct(ents)).alias("entity")))
    made = written(replacements(pairs.select("entity").distinct(), key))
    few = small(made)
    if few is not made:
        replaced = pairs.join(few, "entity")
    else:  # an entity of very many rows is dealt out to several tasks
        salted = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        replaced = pairs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "salt"])
    maps = replaced.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("table"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    kept = hits.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc") if len(docs.columns) > 1 else F.struct(F.lit(0)).alias("doc"), F.col(row).alias("row"), F.col(ents).alias("ents"), F.col(parts).alias("parts"))
    joined = kept.join(maps, "row")
    woven = F.concat(F.array_join(F.zip_with(F.slice("parts", F.lit(1), F.size("ents")), F.col("ents"), lambda part, e: F.concat(part, F.element_at(F.col("table"), e))), ""), F.element_at("parts", -1))
    hit = joined.select(*[woven.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns], F.size("ents").cast("long").alias("n_entities"), F.col("kinds").alias("entity_kinds"))
    return plain.unionByName(hit)
