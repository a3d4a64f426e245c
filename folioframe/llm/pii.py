"""Surrogates for personal data and secrets, with DataFrame functions only.

Entities are found by one pattern, in one pass over the texts. Each has a normal form that no way of writing it changes,
and a replacement made from a key, its kind and that form alone: the same entity is replaced alike everywhere, however
it is written (coreference), digits by digits, letters by letters of the same kind and script, given names by names of
the same gender. A name is as many entities as it has words, so "Mr John Smith" and "Mr Smith" stay one person, and so do
"John Smith" and "Smith" alone in a text that names them with a title.
Replacements are checked over the whole corpus by their normal forms: an entity whose replacement another entity has
too, or which is itself an entity of the corpus, is replaced anew until all differ (distinctness).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

DEFAULT_KEY = "surrogates-1"
#: From this attempt on family names, addresses' local parts and phone numbers become longer, by one more each so many
#: attempts; given names become double (triple, ...) names by one more part each so many attempts.
WIDEN, WIDEN_GIVEN = 8, 2
#: More rounds than that mean that a kind's replacements do not suffice for its entities.
MAX_ROUNDS = 200
#: Entities that need another attempt are put into the plan up to this count; beyond it they are joined, by broadcast
#: up to MAX_BROADCAST rows (some 20 MB), else by a shuffle salted SALTS ways, as a mention may be common to millions.
MAX_INLINE, MAX_BROADCAST, SALTS = 5000, 200_000, 16

#: Titles by gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "госпожа", "г-жа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н", "Κύριος")
#: Given names by script and gender.
GIVEN = {
    "latin": (
        ("Anna", "Clara", "Elena", "Emma", "Irene", "Julia", "Laura", "Lena", "Lucia", "Maria", "Nora", "Olivia", "Paula", "Sara", "Silvia", "Vera"),
        ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Tomas", "Victor"),
    ),
    "cyrillic": (
        ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
        ("Андрей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"),
    ),
    "greek": (
        ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία", "Βασιλική", "Δήμητρα"),
        ("Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Πέτρος", "Στέφανος"),
    ),
}
#: Consonants and vowels of each script.
LETTERS = {
    "latin": ("bcdfghjklmnprstvwxz", "aeiouy"),
    "cyrillic": ("бвгджзклмнпрстфхцчш", "аеиоуыэюя"),
    "greek": ("βγδζθκλμνξπρστφχψ", "αεηιουω"),
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "latin": ""}

_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: Calling codes of one and of two digits; all others have three.
CODES_1, CODES_2 = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: What counts as an entity, by kind, in order of precedence at one place. No group repeats without a bound, as the
#: regex engine recurses on those.
PATTERNS = {
    "key": r"(?<![\p{L}\p{N}])(?:(?=[0-9a-fA-F]{0,62}[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,})(?![\p{L}\p{N}])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@(?=[\p{L}\p{N}])[\p{L}\p{N}.-]*\.\p{L}{2,24}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\p{N}|\.\p{N})",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?!\p{N})|(?<![\p{L}\p{N}.])[0-9]{13,19}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}(?!\p{N})|(?<![\p{L}\p{N}])\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?!\p{N})|(?<![\p{L}\p{N}-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{N}-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(FEMALE_TITLES + MALE_TITLES, key=len, reverse=True))})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
KINDS = tuple(PATTERNS)
#: Marks around a mention and between its alternatives, and what a text's own such characters are escaped with.
OPEN, NEXT, ESCAPE = "", "", ""
ESCAPES = ((ESCAPE, ESCAPE + ""), (NEXT, ESCAPE + ""), (OPEN, ESCAPE + ""))
PATTERN = "|".join(f"({p})" for p in PATTERNS.values())
#: A cheap look at the whole text first: only what has a digit run, an @, the start of a key or a title is searched.
#: Every match of PATTERN holds a match of it, and so must those of a new kind.
HINT = rf"@|[0-9]{{2}}|[0-9]\.[0-9]|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|[0-9a-f]{{32}}|[0-9A-F]{{32}}|(?:{'|'.join(FEMALE_TITLES + MALE_TITLES)})\.? \p{{Lu}}"


def let(value: Column, use) -> Column:
    """use(value), where value stands in the plan once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _phone_form(m: Column) -> Column:
    """Calling code, a bar and the national digits. Ten digits without a code are taken for those of code 1."""

    def form(d: Column) -> Column:
        code = F.when(F.substring(d, 1, 1).isin(*CODES_1), 1).when(F.substring(d, 1, 2).isin(*CODES_2.split()), 2).otherwise(3)
        with_code = let(code, lambda n: F.concat(F.substring(d, F.lit(1), n), F.lit("|"), F.substring(d, n + 1, F.length(d))))
        return F.when(F.startswith(m, F.lit("+")), with_code).when(F.length(d) == 10, F.concat(F.lit("1|"), d)).otherwise(F.concat(F.lit("|"), d))

    return let(_digits_of(m), form)


def normal_form(kind: Column, m: Column) -> Column:
    """What makes two mentions one entity: digits alone for numbers, case folded for the rest but for keys that are not
    hexadecimal, in which case counts."""
    return (
        F.when(kind == "phone", _phone_form(m))
        .when(kind.isin("card", "ssn"), _digits_of(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when((kind == "key") & ~m.rlike("^[0-9a-fA-F]+$"), m)
        .otherwise(F.lower(m))
    )


def pieces(kind: Column, m: Column) -> Column:
    """The entities of a mention, array of (kind, text): the words of a name after its title, else the mention itself."""

    def of_name(words: Column) -> Column:
        title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
        given = F.when(title.isin(*FEMALE_TITLES), "given_f").otherwise("given_m")
        rest = F.slice(words, 2, F.size(words) - 1)
        return F.transform(rest, lambda w, i: F.struct(F.when((i == 0) & (F.size(rest) > 1), given).otherwise("family").alias("kind"), w.alias("text")))

    return F.when(kind == "name", let(F.split(m, " "), of_name)).otherwise(F.array(F.struct(kind.alias("kind"), m.alias("text"))))


def _stream(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits that depend on the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{k}\x1f"), seed), 256) for k in range(4)])


def _number(stream: Column, i: Column, size: int | Column) -> Column:
    """The i-th number (from 0) below size in a stream; four hexadecimal digits each, taken round and round."""
    n = F.conv(F.substring(stream, (i % 64).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("long")
    return F.pmod(n + i, F.lit(size) if isinstance(size, int) else size)


def _pick(stream: Column, i: Column, text: str) -> Column:
    return F.substring(F.lit(text), (_number(stream, i, len(text)) + 1).cast("int"), F.lit(1))


def _chars(m: Column) -> Column:
    return F.filter(F.split(m, ""), lambda c: c != "")


def _letter(low: Column, stream: Column, i: Column) -> Column:
    """A lower-case letter of the same script and kind (vowel or not) in place of low; other characters stay."""
    pool = F.lit(None).cast("string")
    for script in ("latin", "greek", "cyrillic"):  # accented and rarer letters are replaced by vowels
        pool = F.when(low.rlike(SCRIPTS[script] or r"\p{IsLatin}") & low.rlike(r"[^\x00-\x7F]") & low.rlike(r"\p{L}"), LETTERS[script][1]).otherwise(pool)
    for letters in LETTERS.values():
        for text in letters:
            pool = F.when(F.contains(F.lit(text), low), text).otherwise(pool)
    return let(pool, lambda p: F.when(p.isNull(), low).otherwise(F.substring(p, (_number(stream, i, F.length(p)) + 1).cast("int"), F.lit(1))))


def _alike(text: Column, stream: Column) -> Column:
    """Lower-case letters and digits of a text replaced in its own pattern."""
    return F.array_join(F.transform(_chars(text), lambda c, i: F.when(c.rlike("[0-9]"), _pick(stream, i, "0123456789")).otherwise(_letter(c, stream, i))), "")


def _any_digits(text: Column, stream: Column) -> Column:
    """As many digits as text has; a leading zero (and only one) stays zero."""
    first = F.when(F.startswith(text, F.lit("0")), F.lit("0")).otherwise(_pick(stream, F.lit(0), "123456789"))
    return F.array_join(F.transform(_chars(text), lambda c, i: F.when(i == 0, first).otherwise(_pick(stream, i, "0123456789"))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit being undoubled."""

    def term(c, i):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), term), F.lit(0), lambda a, x: a + x)


def _card(normal: Column, stream: Column) -> Column:
    """As many digits; a number that passes the Luhn check gets one that does, and one that fails, one that fails."""

    def ended(made: Column) -> Column:
        head = F.substring(made, F.lit(1), F.length(made) - 1)
        off = _luhn_sum(F.concat(head, F.lit("0"))) % 10
        valid = _luhn_sum(normal) % 10 == 0
        last = let(F.pmod(10 - off, F.lit(10)), lambda check: F.when(valid, check).otherwise(F.pmod(check + 1 + _number(stream, F.lit(63), 9), F.lit(10))))
        return F.concat(head, last.cast("string"))

    return let(_any_digits(normal, stream), ended)


def _mod_97(text: Column) -> Column:
    """Digits and capital letters (A is 10) read as one number, modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(normal: Column, stream: Column) -> Column:
    """The same country, letters by letters and digits by digits; check digits hold exactly if they held before."""
    country, body = F.substring(normal, 1, 2), F.substring(normal, F.lit(5), F.length(normal))
    valid = _mod_97(F.concat(body, country, F.substring(normal, 3, 2))) == 1

    def checked(made: Column) -> Column:
        check = 98 - _mod_97(F.concat(made, country, F.lit("00")))
        off = F.when(valid, check).otherwise(F.pmod(check + 1 + _number(stream, F.lit(63), 90), F.lit(97)))
        return F.concat(country, F.lpad(off.cast("string"), 2, "0"), made)

    return let(F.array_join(F.transform(_chars(body), lambda c, i: F.when(c.rlike("[0-9]"), _pick(stream, i, "0123456789")).otherwise(_pick(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))), ""), checked)


def _more(text: Column, stream: Column, n: Column) -> Column:
    """n more vowels of the script in which text ends."""
    picks = lambda vowels: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(stream, i + 40, vowels)), "")
    out = picks(LETTERS["latin"][1])
    for script in ("greek", "cyrillic"):
        out = F.when(text.rlike(SCRIPTS[script] + "$"), picks(LETTERS[script][1])).otherwise(out)
    return F.when(n > 0, out).otherwise("")


def _given(kind: Column, normal: Column, stream: Column, parts: Column) -> Column:
    """A given name of the gender and script, of as many parts."""

    def of(names: tuple[str, ...]) -> Column:
        table = F.array(*[F.lit(x.lower()) for x in names])
        return F.array_join(F.transform(F.sequence(F.lit(0), parts), lambda i: F.get(table, _number(stream, i, len(names)).cast("int"))), "-")

    out = F.when(kind == "given_f", of(GIVEN["latin"][0])).otherwise(of(GIVEN["latin"][1]))
    for script in ("greek", "cyrillic"):
        out = F.when(normal.rlike(SCRIPTS[script]), F.when(kind == "given_f", of(GIVEN[script][0])).otherwise(of(GIVEN[script][1]))).otherwise(out)
    return out


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity, as a normal form of the same kind."""
    return let(_stream(key, kind, normal, attempt.cast("string")), lambda stream: _surrogate(kind, normal, stream, attempt, key))


def _surrogate(kind: Column, normal: Column, stream: Column, attempt: Column, key: str) -> Column:
    more = F.floor(attempt / WIDEN).cast("int")

    def host(domain: Column) -> Column:
        labels = let(_stream(key, F.lit("domain"), domain), lambda s: _alike(F.regexp_replace(domain, r"\.\p{L}+$", ""), s))
        return F.concat(labels, F.regexp_extract(domain, r"\.\p{L}+$", 0))

    local = F.regexp_extract(normal, "^([^@]*)@", 1)
    email = F.concat(_alike(local, stream), _more(F.lit(""), stream, more), F.lit("@"), let(F.regexp_extract(normal, "@(.*)$", 1), host))
    # 10/8, and where that is full, the addresses kept for future use, from 240/4
    ip = F.concat_ws(".", F.when(more == 0, "10").otherwise((F.lit(239) + F.least(more, F.lit(15))).cast("string")), *[_number(stream, F.lit(i), 256).cast("string") for i in range(3)])
    hexed = F.array_join(F.transform(_chars(normal), lambda c, i: _pick(stream, i, "0123456789abcdef")), "")
    alike = lambda c, i: F.when(c.rlike("[0-9]"), _pick(stream, i, "0123456789")).when(c.rlike("[A-Z]"), _pick(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[a-z]"), _pick(stream, i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c)
    mixed = F.concat(F.substring(normal, 1, 4), F.array_join(F.transform(_chars(F.substring(normal, F.lit(5), F.length(normal))), alike), ""))
    code, national = F.substring_index(normal, "|", 1), F.substring_index(normal, "|", -1)
    extra = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: _pick(stream, i + 40, "0123456789")), "")).otherwise("")
    return (
        F.when(kind == "key", F.when(normal.rlike("^[0-9a-f]+$"), hexed).otherwise(mixed))
        .when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(normal, stream))
        .when(kind == "phone", F.concat(code, F.lit("|"), _any_digits(national, stream), extra))
        .when(kind == "ssn", _any_digits(normal, stream))
        .when(kind == "iban", _iban(normal, stream))
        .when(kind.isin("given_f", "given_m"), _given(kind, normal, stream, F.floor(attempt / WIDEN_GIVEN).cast("int")))
        .otherwise(F.concat(_alike(normal, stream), _more(normal, stream, more)))
    )


def _poured(m: Column, keep: Column, new: Column, fills: str) -> Column:
    """m with its characters that match fills, after the first `keep` ones, replaced by those of new in order, and what
    of new is left behind it. Mentions of numbers are short, so the fold costs little."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        fill = c.rlike(fills)
        char = F.when(fill & (acc["n"] >= keep), F.substring(new, acc["n"] - keep + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], char).alias("out"), (acc["n"] + fill.cast("int")).alias("n"))

    return let(F.aggregate(_chars(m), start, step), lambda x: F.concat(x["out"], F.substring(new, x["n"] - keep + 1, F.length(new))))


def written(kind: Column, m: Column, new: Column) -> Column:
    """A replacement (a normal form) in the way in which mention m of the entity is written."""
    code = F.substring_index(new, "|", 1)
    phone = _poured(m, F.when(F.startswith(m, F.lit("+")), F.length(code)).otherwise(0), F.substring_index(new, "|", -1), "[0-9]")
    cased = F.array_join(F.transform(F.split(new, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "-")
    word = F.when((F.length(m) > 1) & (m == F.upper(m)), F.upper(new)).when(F.substring(m, 1, 1) != F.lower(F.substring(m, 1, 1)), cased).otherwise(new)
    return (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), _poured(m, F.lit(0), new, "[0-9]"))
        .when(kind == "iban", _poured(m, F.lit(0), new, "[A-Z0-9]"))
        .when(kind.isin("family", "given_f", "given_m"), word)
        .when((kind == "key") & m.rlike("^[0-9A-F]*[A-F][0-9A-F]*$"), F.upper(new))
        .otherwise(new)
    )


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs, its whole text searched once: rest (a struct of the other columns), row (a number of its own),
    text (null where entities were found), gaps (the text between them) and found (array of kind, m)."""
    text = F.col(f"`{text_col}`").cast("string")
    own = F.when(text.rlike(f"[{OPEN}-{ESCAPE}]"), _replaced(text, ESCAPES)).otherwise(text)
    marked = F.regexp_replace(own, PATTERN, OPEN + NEXT.join(f"${i + 1}" for i in range(len(KINDS))) + OPEN)
    plain = F.struct(text.alias("text"), F.lit(None).cast("array<string>").alias("gaps"), F.lit(None).cast("array<struct<kind:string,m:string>>").alias("found"))

    def typed(part: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        which = lambda f: F.array_position(F.transform(f, lambda c: c != ""), F.lit(True)).cast("int") - 1
        return let(F.split(part, NEXT, -1), lambda f: F.struct(F.get(kinds, which(f)).alias("kind"), F.array_join(f, "").alias("m")))

    def told(parts: Column) -> Column:
        gaps = F.transform(F.filter(parts, lambda _, i: i % 2 == 0), lambda g: F.when(F.contains(g, F.lit(ESCAPE)), _replaced(g, [(b, a) for a, b in reversed(ESCAPES)])).otherwise(g))
        found = F.transform(F.filter(parts, lambda _, i: i % 2 == 1), typed)
        return F.when(F.size(parts) > 1, F.struct(F.lit(None).cast("string").alias("text"), gaps.alias("gaps"), found.alias("found"))).otherwise(plain)

    told_ = F.when(text.rlike(HINT), let(F.split(marked, OPEN, -1), told)).otherwise(plain)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    made = docs.select(F.struct(*rest).alias("rest"), F.monotonically_increasing_id().alias("row"), told_.alias("told"))
    return durable(made).select("rest", "row", "told.text", "told.gaps", "told.found")


def _pieces(marked: DataFrame) -> DataFrame:
    """row, pos, part, m, kind, normal: the entities of all mentions, in their places."""
    each = marked.filter("found IS NOT NULL").select("row", F.posexplode("found").alias("pos", "x"))
    parts = each.select("row", "pos", F.posexplode(pieces(F.col("x.kind"), F.col("x.m"))).alias("part", "p"))
    return parts.select("row", "pos", "part", F.col("p.text").alias("m"), F.col("p.kind").alias("kind"), normal_form(F.col("p.kind"), F.col("p.text")).alias("normal"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, normal: the distinct entities of all whole texts; common ones are added up map-side."""
    return _pieces(mentions(docs.select(text_col), text_col)).select("kind", "normal").distinct()


def attempts(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """kind, normal, attempt of the entities (kind, normal) whose first replacement is another's or an entity.

    Per round, of those that share a replacement the first keeps it unless it is an entity of the corpus; the others
    draw again. Given names are few and common, so theirs may be those of the corpus, each in place of one other alone.
    Rounds go on until nothing clashes; clashes become rarer by orders of magnitude each time, as those that go on draw
    from larger spaces. If MAX_ROUNDS leave any, that is an error.
    """
    have = durable(found.select("kind", "normal"))
    state = have.withColumn("attempt", F.lit(0))
    to = surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)
    for _ in range(MAX_ROUNDS):
        drawn = durable(state.withColumn("to", to))
        twice = drawn.groupBy("kind", "to").agg(F.count(F.lit(1)).alias("n"), F.min("normal").alias("first")).filter("n > 1")
        real = have.filter("kind NOT LIKE 'given%'").select("kind", F.col("normal").alias("to"), F.lit(True).alias("real"))
        marks = drawn.join(twice, ["kind", "to"], "left").join(real, ["kind", "to"], "left")
        redraw = F.coalesce("real", F.lit(False)) | (F.coalesce("n", F.lit(0)) > 1) & (F.col("normal") != F.col("first"))
        state = durable(marks.select("kind", "normal", (F.col("attempt") + redraw.cast("int")).alias("attempt"), redraw.alias("again")))
        if state.filter("again").isEmpty():
            return state.filter("attempt > 0").select("kind", "normal", "attempt")
        state = state.drop("again")
    raise ValueError(f"replacements still clash after {MAX_ROUNDS} rounds")


def told_again(gaps: Column, found: Column, new: Column) -> Column:
    """gaps, in which the words of the text's own titled names are replaced wherever they stand, titled or not.

    A word counts as it is written behind its title, or in capitals, by itself (a possessive may follow). It is left
    where the same text has it in lower case too, as a word that is not only a name. Words are marked first and then
    replaced, so that no replacement is replaced again. new has each mention with its title and new words.
    """
    words = lambda m: F.slice(F.split(m, " "), 2, 99)
    pair = lambda a, b: F.struct(a.alias("old"), b.alias("new"))
    none = F.array().cast("array<struct<old:string,new:string>>")
    own = F.flatten(F.zip_with(found, new, lambda x, s: F.when(x["kind"] == "name", F.zip_with(words(x["m"]), words(s), pair)).otherwise(none)))
    edged = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}'’-])\Q"), w, F.lit(r"\E(?![\p{L}\p{M}\p{N}]|['’-]\p{L}\p{L})"))
    text = F.array_join(gaps, "\n")

    def replaced(pairs: Column) -> Column:
        mark = lambda i: F.concat(F.lit(OPEN), i.cast("string"), F.lit(OPEN))
        numbered = F.transform(pairs, lambda p, i: F.struct(p["old"].alias("old"), p["new"].alias("new"), mark(i).alias("mark")))

        def gap(g: Column, table: Column) -> Column:
            marked = F.aggregate(table, g, lambda t, p: F.regexp_replace(t, edged(p["old"]), p["mark"]))
            return F.when(F.contains(g, F.lit(OPEN)), g).otherwise(let(marked, lambda m: F.aggregate(table, m, lambda t, p: F.replace(t, p["mark"], p["new"]))))

        return let(numbered, lambda table: F.transform(gaps, lambda g: gap(g, table)))

    loud = lambda p: pair(F.upper(p["old"]), F.upper(p["new"]))
    both = lambda ps: F.array_distinct(F.concat(ps, F.transform(ps, loud)))
    sure = lambda ps: F.filter(ps, lambda p: ~F.regexp_like(text, edged(F.lower(p["old"]))))
    return let(sure(both(own)), replaced)


def count_name(columns: list[str]) -> str:
    """Name of the count's column: n_entities, or the first free one of n_entities_2, n_entities_3, ..."""
    taken = {c.lower() for c in columns}
    return next(n for k in range(1, len(taken) + 3) if (n := f"n_entities_{k}" if k > 1 else "n_entities") not in taken)


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """docs with every entity in text_col replaced, and behind the same columns the entities' number in one more: long,
    n_entities (under another name where docs has that one, see count_name).

    Null and empty texts, and texts without entities, stay as they are (0 entities); whole texts are searched, once.
    Replacements depend on the key and the corpus alone, so rows may come in any order and any number of tasks; rows
    that repeat an id or have none are replaced one by one, and an empty table gives an empty one.
    """
    marked = mentions(docs, text_col)
    again = durable(attempts(_pieces(marked).select("kind", "normal").distinct(), key))
    n = again.count()

    def filled(new: Column) -> Column:
        """The text: gaps, and between them each mention's new words behind its title."""
        joined = lambda gaps, s: F.array_join(F.flatten(F.zip_with(gaps, s, lambda gap, w: F.array(gap, F.coalesce(w, F.lit(""))))), "")
        named = F.exists("found", lambda x: x["kind"] == "name")
        text = let(new, lambda s: F.when(named, joined(told_again(F.col("gaps"), F.col("found"), s), s)).otherwise(joined(F.col("gaps"), s)))
        return F.when(F.col("found").isNull(), F.col("text")).otherwise(text)

    def titled(x: Column, words: Column) -> Column:
        return F.when(x["kind"] == "name", F.concat_ws(" ", F.substring_index(x["m"], " ", 1), words)).otherwise(words)

    def out(rows: DataFrame, new: Column) -> DataFrame:
        keep = [filled(new).alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
        return rows.select(*keep, F.coalesce(F.size("found"), F.lit(0)).cast("long").alias(count_name(docs.columns)))

    if n <= MAX_INLINE:
        table = {f"{r['kind']}\x1f{r['normal']}": r["attempt"] for r in again.collect()}  # at most MAX_INLINE rows
        known = F.from_json(F.lit(json.dumps(table)), "map<string,int>")

        def tries(kind: Column, normal: Column) -> Column:
            return F.coalesce(F.element_at(known, F.concat_ws("\x1f", kind, normal)), F.lit(0)) if table else F.lit(0)

        def word(p: Column) -> Column:
            return let(normal_form(p["kind"], p["text"]), lambda normal: let(surrogate(p["kind"], normal, tries(p["kind"], normal), key), lambda new: written(p["kind"], p["text"], new)))

        new = F.transform("found", lambda x: titled(x, F.array_join(F.transform(pieces(x["kind"], x["m"]), word), " ")))
        return out(marked, new)
    # too many to inline: pieces are joined to their attempts, and each text's replacements gathered again
    parts = _pieces(marked)
    if n <= MAX_BROADCAST:
        tried = parts.join(F.broadcast(again), ["kind", "normal"], "left")
    else:
        dealt = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tried = parts.withColumn("salt", F.pmod(F.col("row") + F.col("pos"), F.lit(SALTS)).cast("int")).join(dealt, ["kind", "normal", "salt"], "left")
    made = tried.select("row", "pos", "part", let(surrogate(F.col("kind"), F.col("normal"), F.coalesce("attempt", F.lit(0)), key), lambda new: written(F.col("kind"), F.col("m"), new)).alias("to"))
    words = made.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "to"))).alias("words"))  # of one text
    joined = marked.join(words, "row", "left")
    new = F.transform("found", lambda x, i: titled(x, F.array_join(F.transform(F.filter("words", lambda w: w["pos"] == i), lambda w: w["to"]), " ")))
    return out(joined, new)
