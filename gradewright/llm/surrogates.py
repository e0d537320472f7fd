"""Surrogates for personal data. Only DataFrame functions.

Detected entities get keyed replacements of the same type and format: letters stay
letters of the same case and script, digits stay digits, separators stay, a card
number that passes its check digit still does, an address octet stays an octet,
and a name is replaced by a name of the same gender and script. The replacement is
a function of the key and the entity, so an entity has one replacement everywhere.

Replacements are checked over the whole corpus: where two entities would share
one, or one would equal an entity that occurs, all but the first get the next
attempt, until none collide. Only those few entities need a lookup; all others are
replaced in their row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import col, free_names, stage, without
from gradewright.session import cut_lineage

# Common given names and surnames by gender and script, replaced by names of their own list.
GIVEN = {
    ("f", "latin"): "Anna Maria Sophie Laura Julia Emma Claire Elena Carmen Ingrid Helen Martha Alice Nora Greta Irene Paula Clara Marie Sabine Heike Monika Isabelle Nathalie Pilar Lucia Sarah Emily".split(),
    ("m", "latin"): "John Peter Paul Thomas Martin Michael Robert James David Carlos Miguel Antonio Jean Pierre Louis Hans Klaus Stefan Andreas Oliver Henry George Victor Hugo Bruno Felix Diego Pablo".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
}
SURNAMES = {
    "latin": "Smith Miller Brown Wilson Taylor Clark Lewis Walker Garcia Lopez Martinez Torres Müller Schmidt Fischer Weber Wagner Becker Bernard Dubois Moreau Laurent Lefebvre Rossi Novak Jensen Hansen Larsen".split(),
    "cyrillic": "Иванов Петров Сидоров Кузнецов Смирнов Попов Соколов Лебедев".split(),
}
TITLES = {"m": "Mr Mr. Herr Señor Sr. Monsieur".split(), "f": "Mrs Mrs. Ms Ms. Miss Frau Señora Sra. Madame Mme".split(), "": "Dr Dr. Prof Prof. Mx Mx.".split()}
ATTEMPTS = 12  # after so many collisions an entity gets a marked, certainly distinct surrogate


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w))) + ")"


def _every_given() -> list[str]:
    return sorted({n for names in GIVEN.values() for n in names})


#: What tells the type of a secret; it stays.
MARKED = r"github_pat_|gh[pousr]_|[spr]k_(?:live|test)_|glpat-|npm_|xox[abps]-"
SECRET_PREFIX = r"(?:github_pat_|sk_live_|sk_test_|pk_live_|pk_test_|rk_live_|sk|pk|gh[pousr]|xox[abps]|AKIA|ASIA|AIza|glpat|npm)"
#: Country codes of telephone numbers by their first digits; all others have three.
COUNTRY_CODE = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLED = _any([t for titles in TITLES.values() for t in titles])
#: Types in the order in which they are looked for at a place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("secret", r"(?<![0-9A-Fa-f])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Fa-f])"),
    ("secret", r"(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza)[-_]?[A-Za-z0-9_-]{16,}"),
    ("secret", rf"(?<![A-Za-z0-9])(?:{MARKED}|ASIA)[A-Za-z0-9_-]{{16,}}"),
    ("secret", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![\d.])(?:(?:\d{4}[ -]?){3}\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:.])"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"),
    ("name", rf"(?<!\p{{L}}){_TITLED} {NAME}(?: {NAME})?|(?<!\p{{L}}){_any(_every_given())} {NAME}"),
)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)


@dataclass(frozen=True)
class Key:
    """The secret under which surrogates are made."""

    secret: str = "gradewright"

    def digest(self, *parts: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(self.secret), *parts), 256)


def kind_of(entity: Column) -> Column:
    """Type of an entity: the first whose pattern matches it whole."""
    made = None
    for kind, pattern in PATTERNS:
        test = entity.rlike(f"^(?:{pattern})$")
        made = F.when(test, F.lit(kind)) if made is None else made.when(test, F.lit(kind))
    return F.coalesce(made, F.lit("other"))


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same: digits of numbers, lower case of addresses."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"[^\d+]", ""))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip6"), F.lower(entity))
        .otherwise(entity)
    )


def _keyed_chars(text: Column, digest: Column) -> Column:
    """Each letter and digit moved by the digest within its own kind; the rest as it is."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i % 7
        code = F.ascii(c)
        return (
            F.when(c.between("0", "9"), F.char(48 + (code - 48 + by) % 10))
            .when(c.between("a", "z"), F.char(97 + (code - 97 + by) % 26))
            .when(c.between("A", "Z"), F.char(65 + (code - 65 + by) % 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def _hex_like(text: Column, digest: Column) -> Column:
    """As many hex digits, in the same case."""
    more = F.concat(digest, F.sha2(digest, 256))
    made = F.substring(more, F.lit(1), F.char_length(text))
    return F.when(text == F.upper(text), F.upper(made)).otherwise(made)


def _refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced in turn, its separators kept."""
    parts = F.split(F.regexp_replace(text, r"\d", "\u0001"), "\u0001")
    chars = F.split(digits, "")
    return F.array_join(F.zip_with(parts, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def _decimal(digest: Column, n: Column) -> Column:
    """n keyed decimal digits."""
    more = F.concat(digest, F.sha2(digest, 256))
    return F.substring(F.translate(more, "abcdef", "140629"), F.lit(1), n)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one at place 0."""
    places = F.split(F.reverse(digits), "")
    values = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _card(entity: Column, digest: Column) -> Column:
    """As many digits, the first and the validity of the check digit as before."""
    digits = F.regexp_replace(entity, r"\D", "")
    kept = F.when(F.char_length(digits) == 15, 2).otherwise(1)  # cards of 15 digits are told by two
    body = F.concat(F.substring(digits, F.lit(1), kept), _decimal(digest, F.char_length(digits) - kept - 1))
    check = ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    wrong = F.substring(F.concat(check.cast("int") + 1 + F.conv(F.substring(digest, 60, 1), 16, 10).cast("int") % 9), -1, 1)
    return _refilled(entity, F.concat(body, F.when(_luhn_sum(digits) % 10 == 0, check).otherwise(wrong)))


def _phone(entity: Column, digest: Column) -> Column:
    """The country code stays; a number's first digit is never 0 or 1 where it was not."""
    code = F.regexp_extract(entity, "^" + COUNTRY_CODE, 0)
    rest = F.substring(entity, F.char_length(code) + 1, F.char_length(entity))
    digits = F.regexp_replace(rest, r"\D", "")
    made = _decimal(digest, F.char_length(digits))
    first = F.when(digits.rlike("^[2-9]") & made.rlike("^[01]"), F.translate(F.substring(made, 1, 1), "01", "35")).otherwise(F.substring(made, 1, 1))
    return F.concat(code, _refilled(rest, F.concat(first, F.substring(made, F.lit(2), F.char_length(made)))))


def _mod_97(text: Column) -> Column:
    """The remainder of an account number as its check digits count it: letters are 10 to 35, the first four characters come last."""
    turned = F.concat(F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda left, c: F.when(
        c.between("0", "9"), (left * 10 + F.ascii(c) - 48) % 97).when(c.between("A", "Z"), (left * 100 + F.ascii(c) - 55) % 97).otherwise(left))


def _iban(entity: Column, digest: Column) -> Column:
    """Made for the number without blanks, which then go where they were: the country
    stays, and check digits are right where they were."""
    plain = F.replace(entity, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)
    body = _keyed_chars(F.substring(plain, F.lit(5), F.char_length(plain)), digest)
    check = 98 - _mod_97(F.concat(country, F.lit("00"), body))
    check = F.when(_mod_97(plain) == 1, check).otherwise((check + 1 + F.conv(F.substring(digest, 60, 1), 16, 10).cast("int")) % 97)
    made = F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)
    # Every character after as many others as it has before it in the number without blanks.
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(
        F.substring(made, F.char_length(F.replace(F.substring(entity, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")


def _secret(entity: Column, digest: Column) -> Column:
    """The prefix stays, and of a signed token the beginning that marks its parts."""
    prefix = F.regexp_extract(entity, rf"^(?:{SECRET_PREFIX}[-_]?|eyJ)", 0)
    return F.concat(prefix, _keyed_chars(F.substring(entity, F.char_length(prefix) + 1, F.char_length(entity)), digest))


def _ip6(entity: Column, digest: Column) -> Column:
    """Groups of the same number of hex digits, none with a leading zero that had none, in the case of the address."""
    def group(g: Column, i: Column) -> Column:
        own = F.substring(digest, i * 4 + 1, F.char_length(g))
        return F.when(g.rlike("^[1-9A-Fa-f]") & own.startswith("0"), F.concat(F.lit("a"), F.substring(own, F.lit(2), F.char_length(own)))).otherwise(own)

    made = F.array_join(F.transform(F.split(F.lower(entity), ":"), group), ":")
    return F.when(entity == F.lower(entity), made).otherwise(F.upper(made))


def _ip(entity: Column, digest: Column) -> Column:
    """Octets of the same number of digits."""
    def octet(o: Column, i: Column) -> Column:
        x = F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.when(F.char_length(o) == 3, 100 + x % 156).when(F.char_length(o) == 2, 10 + x % 90).otherwise(x % 10).cast("string")

    return F.array_join(F.transform(F.split(entity, r"\."), octet), ".")


def _picked(names: list[str], digest: Column, at: int) -> Column:
    x = F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return F.element_at(F.array(*[F.lit(n) for n in names]), (x % len(names) + 1).cast("int"))


def _name(entity: Column, key: Key, attempt: Column) -> Column:
    """Title kept; given name of the same gender and script, surname of the same script."""
    words = F.split(entity, " ")
    title = F.element_at(words, 1)
    titled = title.isin(*[t for titles in TITLES.values() for t in titles])
    cyrillic = entity.rlike(r"\p{IsCyrillic}")
    # Each word of a name has its own replacement, so parts of a name agree across mentions.
    def part(w: Column, i: Column) -> Column:
        digest = key.digest(F.lit("name"), w, attempt.cast("string"))

        def surname(at: int) -> Column:
            return F.when(cyrillic, _picked(SURNAMES["cyrillic"], digest, at)).otherwise(_picked(SURNAMES["latin"], digest, at))

        def given(gender: str) -> Column:
            return F.when(cyrillic, _picked(GIVEN[gender, "cyrillic"], digest, 1)).otherwise(_picked(GIVEN[gender, "latin"], digest, 1))

        # Later attempts join surnames, so that there are always names left.
        made = F.when(attempt < 2, surname(1)).when(attempt < 5, F.concat_ws("-", surname(1), surname(9))).otherwise(
            F.concat_ws("-", surname(1), surname(9), surname(17)))
        # A first name that no list has goes by its title.
        first = titled & (i == 1) & (F.size(words) == 3)
        made = F.when(first & title.isin(*TITLES["m"]), given("m")).when(first & title.isin(*TITLES["f"]), given("f")).otherwise(made)
        for (_gender, _script), names in GIVEN.items():
            made = F.when(w.isin(*names), _picked(names, digest, 1)).otherwise(made)
        return made

    return F.array_join(F.transform(words, lambda w, i: F.when(titled & (i == 0), w).otherwise(part(w, i))), " ")


def _email(entity: Column, key: Key, attempt: Column) -> Column:
    """Local part and domain by themselves, so that people of one domain still share one; its end stays."""
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    end = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    front = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(end))
    return F.concat(
        _keyed_chars(local, key.digest(F.lit("local"), F.lower(entity), attempt.cast("string"))), F.lit("@"),
        _keyed_chars(front, key.digest(F.lit("domain"), F.lower(domain))), end)


def surrogate(kind: Column, entity: Column, digest: Column, key: Key, attempt: Column) -> Column:
    """The replacement of an entity, whose digest is made of kind, canonical form and attempt."""
    return (
        F.when(attempt >= ATTEMPTS, F.concat(F.lit("["), kind, F.lit(" "), digest, F.lit("]")))
        .when(kind == "email", _email(entity, key, attempt))
        .when(kind == "name", _name(entity, key, attempt))
        .when(kind == "card", _card(entity, digest))
        .when(kind == "phone", _phone(entity, digest))
        .when(kind == "ip", _ip(entity, digest))
        .when(kind == "ip6", _ip6(entity, digest))
        .when(kind == "iban", _iban(entity, digest))
        .when(kind == "ssn", _refilled(entity, _decimal(digest, F.lit(9))))
        .when((kind == "secret") & entity.rlike("^[0-9A-Fa-f]+$"), _hex_like(entity, digest))
        .when(kind == "secret", _secret(entity, digest))
        .otherwise(_keyed_chars(entity, digest))
    )


def _entities(text: Column) -> Column:
    """Entities in the order of the text; most texts have no digit, sign or name to start from."""
    likely = text.rlike(rf"[0-9@]|(?<![A-Za-z0-9])(?:{MARKED})[A-Za-z0-9_-]{{16}}") | text.rlike(rf"(?<!\p{{L}})(?:{_TITLED}|{_any(_every_given())}) \p{{Lu}}")
    return F.when(likely, F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def _typed(entities: Column) -> Column:
    return F.transform(entities, lambda e: F.struct(kind_of(e).alias("kind"), e.alias("entity")))


def _named(typed: Column) -> Column:
    return F.transform(typed, lambda e: F.struct(
        e["kind"].alias("kind"), e["entity"].alias("entity"), canonical(e["kind"], e["entity"]).alias("same")))


def _with_surrogate(df: DataFrame, key: Key) -> DataFrame:
    """Rows of kind, entity, same, attempt with `surrogate` and its canonical form `taken`."""
    df = stage(without(df, "digest", "surrogate", "taken"), digest=key.digest(col("kind"), col("same"), col("attempt").cast("string")))
    df = stage(df, surrogate=surrogate(col("kind"), col("entity"), col("digest"), key, col("attempt")))
    return df.withColumn("taken", canonical(col("kind"), col("surrogate"))).drop("digest")


def attempts(found: DataFrame, key: Key) -> DataFrame:
    """Entities (kind, entity, same) that need another than the first attempt: kind, same, attempt.

    Over all entities of the corpus: no two have one surrogate, and no surrogate
    is an entity that occurs. Of those that collide the smallest keeps its own.
    """
    each = found.groupBy("kind", "same").agg(F.min("entity").alias("entity"))
    now = cut_lineage(_with_surrogate(each.withColumn("attempt", F.lit(0)), key))
    real = now.select("kind", col("same").alias("taken"))
    while True:
        shared = now.groupBy("kind", "taken").agg(F.min("same").alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = now.join(cut_lineage(shared.drop("n")), ["kind", "taken"]).where("same != first").select("kind", "same")
        real_hit = now.where(f"attempt < {ATTEMPTS}").join(real, ["kind", "taken"], "left_semi").select("kind", "same")
        again = cut_lineage(shared.union(real_hit).distinct().withColumn("again", F.lit(True)))
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "same", "attempt")
        marked = cut_lineage(now.join(again, ["kind", "same"], "left"))
        redone = _with_surrogate(marked.where("again").drop("again").withColumn("attempt", col("attempt") + 1), key)
        now = cut_lineage(marked.where("again is null").drop("again").unionByName(redone))


def replace(docs: DataFrame, key: Key = Key(), text: str = "text") -> DataFrame:
    """The rows with surrogates in their text, and `entities`: kind, entity, surrogate in order.

    A NULL text stays NULL, a text without entities stays as it is. Equal entities
    get equal surrogates in all rows. An input column `entities` gives way.
    """
    docs = without(docs, "entities")
    found, typed, named, digests, made, mark, pick, other = free_names(
        docs, "_found", "_typed", "_named", "_digests", "_made", "_mark", "_pick", "_other")
    # One row per entity and text; equal texts count once.
    seen = docs.select(F.xxhash64(col(text)).alias("of"), _entities(col(text)).alias("found")).where(F.size("found") > 0)
    seen = stage(seen, typed=_typed(F.array_distinct(col("found"))))
    seen = cut_lineage(seen.select("of", F.inline(_named(col("typed")))).distinct())
    more = cut_lineage(attempts(seen.select("kind", "entity", "same").distinct(), key))
    pair = F.struct(F.concat_ws(" ", "kind", "same"), "attempt")
    picks = cut_lineage(
        seen.select("of", "kind", "same").distinct().join(more, ["kind", "same"])
        .groupBy(col("of").alias(other)).agg(F.map_from_entries(F.collect_list(pair)).alias(pick)))

    df = docs.withColumn(mark, F.xxhash64(col(text))).join(picks, col(mark) == col(other), "left")
    df = stage(df, **{found: _entities(col(text))})
    df = stage(df, **{typed: _typed(col(found))})
    attempt = lambda e: F.coalesce(F.element_at(col(pick), F.concat_ws(" ", e["kind"], e["same"])), F.lit(0))
    df = stage(df, **{named: F.transform(_named(col(typed)), lambda e: F.struct(e["kind"].alias("kind"), e["entity"].alias("entity"), e["same"].alias("same"), attempt(e).alias("attempt")))})
    df = stage(df, **{digests: F.transform(col(named), lambda e: key.digest(e["kind"], e["same"], e["attempt"].cast("string")))})
    df = stage(df, **{made: F.zip_with(col(named), col(digests), lambda e, d: F.struct(
        e["kind"].alias("kind"), e["entity"].alias("entity"), surrogate(e["kind"], e["entity"], d, key, e["attempt"]).alias("surrogate")))})
    parts = F.split(col(text), ENTITY, -1)
    whole = F.array_join(F.zip_with(parts, col(made), lambda p, e: F.concat(p, F.coalesce(e["surrogate"], F.lit("")))), "")
    replaced = F.when(F.size(col(found)) > 0, whole).otherwise(col(text))
    return df.select(*[(replaced.alias(c) if c.lower() == text.lower() else col(c)) for c in docs.columns], col(made).alias("entities"))


def without_private(docs: DataFrame, key: Key = Key(), text: str = "text") -> DataFrame:
    """The rows with surrogates in their text, with the columns of the input."""
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    held = docs.select(F.struct(*[col(c) for c in rest]).alias("row") if rest else F.lit(None).alias("row"), col(text).alias("text"))
    made = replace(held, key)
    return made.select(*[col("text").alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
