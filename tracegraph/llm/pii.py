"""Personal data replaced by keyed surrogates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.tables import quoted, saved
from tracegraph.operators.shared import salted_join

# How entities look, in the order in which they are tried. Each begins with a
# test of one or two characters, so that most places of a text are passed over at once.
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?=[0-9])(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
IBAN = r"(?=[A-Z]{2}[0-9])(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![\p{L}\p{N}])"
SSN = r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?=[+(])(?<![\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?=[+])(?<![\p{N}])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?=[0-9])(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"
CARD = r"(?=[0-9])(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{16})(?=[_/+-]*[A-Za-z0-9])(?<=(?i:token|secret|passwd|password|api_key|apikey|key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9_/+-]{16,}"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Господин"
FEMALE_NAMES = "Anna|Maria|Julia|Laura|Emma|Sophie|Claire|Elena|Sarah|Alice|Katharina|Isabel|Carmen|Lucía|Елена|Анна|Мария|Ольга"
MALE_NAMES = "John|Peter|Thomas|Paul|David|Michael|Pierre|Louis|Hans|Karl|Carlos|Javier|Miguel|James|Иван|Пётр|Сергей|Павел"
WORD = r"\p{Lu}[\p{L}'-]+"
NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:(?:{FEMALE_TITLES}|{MALE_TITLES})\.? {WORD}(?: {WORD})?)|(?:(?:{FEMALE_NAMES}|{MALE_NAMES}) {WORD}))(?![\p{{L}}\p{{N}}])"
ENTITY = "|".join([EMAIL, IP, IBAN, SSN, PHONE, CARD, SECRET, NAME])

# Names and syllables that surrogates are made of, by gender and script.
GIVEN = {
    ("latin", "f"): "Ada Berta Clara Dora Edith Flora Greta Hilda Irma Jana Klara Lydia Marta Nora Olga Paula".split(),
    ("latin", "m"): "Alban Bruno Cyril Denis Edgar Fritz Georg Hugo Igor Jakob Kurt Leon Max Nils Oskar Philip".split(),
    ("latin", "u"): "Alex Kim Robin Sasha Charlie Jules Noa Toni".split(),
    ("cyrillic", "f"): "Алла Вера Дарья Жанна Зоя Инна Кира Лидия".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Илья Фёдор".split(),
    ("cyrillic", "u"): "Саша Женя Валя Слава".split(),
}
SYLLABLES = {
    "latin": "bar ken dol fir gam hel jor lan mir nev pol ras sev tor vel win".split(),
    "cyrillic": "бар вел гор дан зем кор лан мир нев пол рас сев тор фил хол чер".split(),
}
ALPHABETS = [
    ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[\\u00DF-\\u00FF]", "àáâäçèéêëìíîïñòóôöùúûü"), ("[\\u00C0-\\u00DE]", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"),
    ("[\\u0430-\\u044F]", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), ("[\\u0410-\\u042F]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    ("[\\u03B1-\\u03C9]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[\\u0391-\\u03A9]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
]
# Scripts that only some texts use; whatever letter or digit none of them holds becomes a Latin letter or a digit.
OTHER_ALPHABETS = [
    ("(?=\\p{IsLatin})\\p{Lu}", "ĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽŐŰĞİŞ"), ("(?=\\p{IsLatin})\\p{L}", "ąćęłńśźżčďěňřšťůžőűğış"),
    ("(?=\\p{IsCyrillic})\\p{Lu}", "ЁЂЃЄЅІЇЈЉЊЋЌЎЏ"), ("(?=\\p{IsCyrillic})\\p{L}", "ёђѓєѕіїјљњћќўџ"),
    ("(?=\\p{IsGreek})\\p{Lu}", "ΆΈΉΊΌΎΏ"), ("(?=\\p{IsGreek})\\p{L}", "άέήίόύώ"),
    ("\\p{IsHan}", "".join(chr(0x4E00 + 64 * k) for k in range(256))), ("\\p{IsHiragana}", "".join(map(chr, range(0x3042, 0x3094)))),
    ("\\p{IsKatakana}", "".join(map(chr, range(0x30A2, 0x30F4)))), ("\\p{IsHangul}", "".join(chr(0xAC00 + 43 * k) for k in range(256))),
    ("\\p{IsHebrew}", "".join(map(chr, range(0x05D0, 0x05EB)))), ("\\p{IsArabic}", "".join(map(chr, [*range(0x0627, 0x063B), *range(0x0641, 0x064B)]))),
    ("\\p{IsThai}", "".join(map(chr, range(0x0E01, 0x0E2F)))), ("\\p{IsDevanagari}", "".join(map(chr, range(0x0905, 0x093A)))),
    ("\\p{L}", "abcdefghijklmnopqrstuvwxyz"), ("\\p{N}", "0123456789"),
]
# A surrogate gets a character (a name a syllable) more after every so many attempts.
ATTEMPTS_PER_LENGTH = 3


def kind_of(found: Column) -> Column:
    """The type of a matched string."""
    whole = [("email", EMAIL), ("ip", IP), ("iban", IBAN), ("ssn", SSN), ("phone", PHONE), ("card", CARD)]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in whole:
        out = out.when(F.rlike(found, F.lit(f"^(?:{pattern})$")), F.lit(name))
    return out.when(F.rlike(found, F.lit(r"^[A-Za-z0-9_/+-]{16,}$")), F.lit("secret")).otherwise(F.lit("name"))


def _bare_name(found: Column) -> Column:
    return F.regexp_replace(found, rf"^(?:{FEMALE_TITLES}|{MALE_TITLES})\.? ", "")


def canonical(kind: Column, found: Column) -> Column:
    """What two mentions of one entity have in common, whatever their format."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    country = F.regexp_extract(found, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    own = F.regexp_replace(F.substr(found, F.length(country) + 1), "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.ltrim(F.concat(country, F.lit(" "), own)))
        .when(kind == "email", F.lower(found))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "name", F.lower(_bare_name(found)))
        .otherwise(found)
    )


def gender_of(found: Column) -> Column:
    female = F.rlike(found, F.lit(rf"^(?:(?:{FEMALE_TITLES})\.? |(?:{FEMALE_NAMES}) )"))
    male = F.rlike(found, F.lit(rf"^(?:(?:{MALE_TITLES})\.? |(?:{MALE_NAMES}) )"))
    return F.when(female, F.lit("f")).when(male, F.lit("m")).otherwise(F.lit("u"))


def _stream(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """Hexadecimal digits that only the key's holder can derive, two for every character and some more."""
    blocks = F.sequence(F.lit(0), (F.length(value) / 32).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, value, F.lit(attempt), b.cast("string")), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, i * 2 - 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: Column, number: Column) -> Column:
    return F.element_at(choices, F.pmod(number, F.size(choices)) + 1)


def _scrambled(value: Column, stream: Column, fixed: Column) -> Column:
    """Every letter and digit replaced by another of its script, case and class; the first and last ``fixed`` characters stay."""
    lead, tail = fixed["lead"], fixed["tail"]

    def one(i: Column) -> Column:
        c, b = F.substr(value, i, F.lit(1)), _byte(stream, i)
        out = F.when((i <= lead) | (i > F.length(value) - tail), c)
        hexadecimal = F.rlike(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")) & F.rlike(value, F.lit("[A-Fa-f]"))
        out = out.when(hexadecimal, F.when(F.rlike(value, F.lit("[a-f]")), F.substr(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1))).otherwise(F.substr(F.lit("0123456789ABCDEF"), b % 16 + 1, F.lit(1))))
        for pattern, letters in ALPHABETS:
            out = out.when(F.rlike(c, F.lit(pattern)), F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1)))
        rare = F.when(F.lit(False), c)
        for pattern, letters in OTHER_ALPHABETS:
            rare = rare.when(F.rlike(c, F.lit(pattern)), F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1)))
        return out.when(F.rlike(c, F.lit("[\\p{L}\\p{N}]")), rare).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _with_check_digit(value: Column, digits: Column) -> Column:
    """The last digit set so that the Luhn sum holds exactly if it holds for the value."""
    front = F.substr(digits, F.lit(1), F.length(digits) - 1)
    right = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(front, d.cast("string")))), 1)
    own = F.substr(digits, F.length(digits), F.lit(1)).cast("int")
    last = F.when(F.call_function("luhn_check", value), right).otherwise(F.when(own == right, F.pmod(own + 1, F.lit(10))).otherwise(own))
    return F.concat(front, last.cast("string"))


def surrogate(key: str, kind: Column, value: Column, gender: Column, attempt: int) -> Column:
    """The replacement of a canonical value at the given attempt; later attempts give longer ones, so there is always a free one."""
    stream = _stream(key, kind, value, attempt)
    extra = attempt // ATTEMPTS_PER_LENGTH
    more = F.sha2(F.concat_ws("|", F.lit(key), kind, value, F.lit(attempt), F.lit("more")), 256)
    # Hexadecimal digits as letters or as digits.
    letters, digits = (F.translate(F.substr(more, F.lit(1), F.lit(extra)), "0123456789abcdef", to) for to in ("ghijklmnopabcdef", "0123456789012345"))
    # Top-level domain, dialling code and country of a bank account are not personal.
    lead = F.when(kind == "iban", 2).when(kind == "phone", F.instr(value, " ")).otherwise(0)
    tail = F.when(kind == "email", F.length(F.substring_index(value, ".", -1))).otherwise(0)
    mixed = _scrambled(value, stream, {"lead": lead, "tail": tail})
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: _byte(stream, i).cast("string")), ".")
    cyrillic = F.rlike(value, F.lit("[\\u0400-\\u04FF]"))
    given = F.when(F.lit(False), F.array(F.lit("")))
    for (script, who), names in GIVEN.items():
        given = given.when((cyrillic if script == "cyrillic" else ~cyrillic) & (gender == who), F.array(*[F.lit(n) for n in names]))
    parts = F.when(cyrillic, F.array(*[F.lit(s) for s in SYLLABLES["cyrillic"]])).otherwise(F.array(*[F.lit(s) for s in SYLLABLES["latin"]]))
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(3), F.lit(6 + extra)), lambda i: _pick(parts, _byte(stream, i))), ""))
    family = F.when(cyrillic, F.concat(family, F.when(gender == "f", F.lit("ова")).otherwise(F.lit("ов")))).otherwise(family)
    name = F.when(F.instr(value, " ") > 0, F.concat_ws(" ", _pick(given, _byte(stream, F.lit(1))), family)).otherwise(family)
    out = F.when(kind == "ip", octets).when(kind == "name", name).when(kind == "card", _with_check_digit(value, mixed)).otherwise(mixed)
    if not extra:
        return out
    return F.when(kind == "name", name).when(kind == "email", F.concat(letters, out)).when(kind == "secret", F.concat(out, letters)).when(kind == "ip", F.concat(out, F.lit("."), digits)).otherwise(F.concat(out, digits))


def rendered(kind: Column, found: Column, new: Column) -> Column:
    """The surrogate in the format of one mention: separators, case and title as there."""
    plain = F.regexp_replace(new, "[^A-Z0-9]", "")
    letters = F.transform(
        F.sequence(F.lit(1), F.length(found)),
        lambda i: F.when(F.rlike(F.substr(found, i, F.lit(1)), F.lit("[A-Z0-9]")), F.substr(plain, F.length(F.regexp_replace(F.substr(found, F.lit(1), i), "[^A-Z0-9]", "")), F.lit(1))).otherwise(F.substr(found, i, F.lit(1))),
    )
    cased = F.transform(
        F.sequence(F.lit(1), F.length(found)),
        lambda i: F.when(F.rlike(F.substr(found, i, F.lit(1)), F.lit("\\p{Lu}")), F.upper(F.substr(new, i, F.lit(1)))).otherwise(F.substr(new, i, F.lit(1))),
    )
    title = F.regexp_extract(found, rf"^(?:(?:{FEMALE_TITLES}|{MALE_TITLES})\.? )?", 0)
    loud = _bare_name(found) == F.upper(_bare_name(found))
    # What a longer surrogate has beyond the mention.
    beyond = F.substr(plain, F.length(F.regexp_replace(found, "[^A-Z0-9]", "")) + 1)
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), F.concat(F.array_join(letters, ""), beyond))
        .when(kind == "email", F.concat(F.array_join(cased, ""), F.substr(new, F.length(found) + 1)))
        .when(kind == "name", F.concat(title, F.when(loud, F.upper(new)).otherwise(new)))
        .otherwise(new)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, new) for distinct (kind, value, gender).

    No two values of a type get the same surrogate, and no surrogate is a value that
    occurs: where that would happen the smallest value keeps it and the others try again
    with the next attempt. A type with almost as many values as its format allows gets
    longer surrogates, so all values are settled.
    """
    known = entities.select("kind", F.when(F.col("kind") == "name", F.initcap("value")).otherwise(F.col("value")).alias("new")).distinct()
    waiting, taken, attempt = entities, None, 0
    while True:
        tried = saved(waiting.withColumn("new", surrogate(key, F.col("kind"), F.col("value"), F.col("gender"), attempt)), "surrogates")
        best = tried.groupBy("kind", "new").agg(F.min("value").alias("value")).join(known, ["kind", "new"], "left_anti")
        if taken is not None:
            best = best.join(taken.select("kind", "new"), ["kind", "new"], "left_anti")
        won = best.select("kind", "value", "new")
        taken = saved(won if taken is None else taken.unionByName(won), "chosen")
        waiting = saved(tried.drop("new").join(taken, ["kind", "value"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return taken
        attempt += 1


def replace_private(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, entities (how many were replaced).

    A value gets the same surrogate in all documents and formats, other values get others,
    and both depend on ``key``. Everything outside the entities stays as it is; null and
    empty texts and texts without an entity come back unchanged with 0. Rows that repeat
    are kept. Other columns are ignored.
    """
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    has = F.coalesce(F.rlike("text", F.lit(ENTITY)), F.lit(False))
    # The patterns take most of the time; what they find is kept, not searched for again.
    hits = saved(source.filter(has).withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256)), "hits")
    found = hits.select("sha", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("place", "found"))
    kind = F.when(F.col("found") == "", F.lit("")).otherwise(kind_of(F.col("found")))
    mentions = saved(
        found.withColumn("kind", kind).withColumn("value", canonical(F.col("kind"), F.col("found"))).withColumn("gender", gender_of(F.col("found"))), "mentions"
    )
    entities = mentions.groupBy("kind", "value").agg(F.min("gender").alias("gender"))
    chosen = surrogates(entities, key)
    # Copies of a text share their mentions.
    single = mentions.select("sha", "place", "found", "kind", "value").distinct()
    named = salted_join(single, chosen, ["kind", "value"]).select("sha", F.struct("place", rendered(F.col("kind"), F.col("found"), F.col("new")).alias("new")).alias("m"))
    lists = saved(named.groupBy("sha").agg(F.sort_array(F.collect_list("m")).alias("m")), "replacements")
    gaps = F.split("text", ENTITY, -1)
    filled = F.concat(
        F.array_join(F.transform(F.sequence(F.lit(1), F.size("m")), lambda i: F.concat(F.element_at(gaps, i), F.element_at(F.col("m"), i)["new"])), ""),
        F.element_at(gaps, -1),
    )
    changed = salted_join(hits, lists, ["sha"]).select("doc_id", filled.alias("text"), F.size("m").cast("long").alias("entities"))
    return source.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("entities")).unionByName(changed)
