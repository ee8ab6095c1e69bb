"""Surrogates for personal data and secrets, with DataFrame functions alone.

Detected entities are cut out of the text, brought to a normal form (so that two
spellings of one number are one entity) and collected over the whole table. Every
different entity gets a replacement drawn from a keyed hash, of the same type and
format; a replacement that another entity has, or that is itself an entity of the
table, is drawn again, until all are different. So equal entities have equal
surrogates in all documents and different ones never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.llm.common import let, materialize, read_table

KEY = "surrogates-1"
#: Draws in the entity's own shape, before characters are added: few for emails and
#: secrets; numbers and addresses get more digits only if their shape is nearly used up.
OWN_SHAPE, OWN_DIGITS = 4, 24

# Titles by gender.
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña",
          "Госпожа", "г-жа"]
EITHER = ["Dr", "Prof", "Доктор"]

# Names for surrogates by kind and script.
NAMES = {
    "given_m_latin": ["Adrian", "Bruno", "Caspar", "Dennis", "Edgar", "Felix", "Gregor", "Hugo",
                      "Ivan", "Julian", "Konrad", "Leon", "Martin", "Norbert", "Oscar", "Paul"],
    "given_f_latin": ["Agnes", "Bianca", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena",
                      "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    "given_x_latin": ["Alex", "Charlie", "Dominique", "Jamie", "Kim", "Lou", "Morgan", "Robin"],
    "family_latin": ["Albers", "Becker", "Castell", "Dorn", "Ebert", "Falk", "Gerard", "Hartwig",
                     "Ibanez", "Jansen", "Keller", "Lambert", "Moreau", "Navarro", "Olsen",
                     "Peralta", "Quint", "Richter", "Santoro", "Thorne"],
    "given_m_cyrillic": ["Алексей", "Борис", "Виктор", "Глеб", "Дмитрий", "Егор", "Игорь", "Кирилл"],
    "given_f_cyrillic": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения"],
    "given_x_cyrillic": ["Саша", "Женя", "Валя"],
    "family_cyrillic": ["Громенко", "Дубко", "Коваленко", "Лисенко", "Марченко", "Петренко"],
}

_TITLE = "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]+"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}"
SECRET_HEAD = (r"(?i)(?<![\p{L}\p{N}])(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)"
               r"[\"']?\s{0,3}[:=]\s{0,3}(?:(?:bearer|basic)\s{1,3})?(?-i)[\"']?")
# within quotes; or a run of a key's characters, without marks that follow it; or anything
# up to the last letter or digit before white space or a quote
SECRET = (SECRET_HEAD + r"(?:(?<=\")(?=[^\"\n]*[\p{L}\p{N}])[^\"\n]+(?=\")"
          r"|(?<=')(?=[^'\n]*[\p{L}\p{N}])[^'\n]+(?=')"
          r"|(?=[^\s\"']{0,60}[0-9])[A-Za-z0-9_+/=-]{12,}+(?![^\s\"']*[\p{L}\p{N}])"
          r"|[^\s\"']*[\p{L}\p{N}])")
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])"
# a country code and groups of one or more digits; or in national forms: an area code in
# brackets, a trunk prefix (five pairs; an area code and 5 to 8 more digits, or so many in
# groups), 3-3-4 digits, Spanish 2-3-2-2 and 3-2-2-2 digits
_GAP = r"[ \x{A0}\x{202F}./-]"
_BLANK = r"[ \x{A0}\x{202F}]"
PHONE = (rf"(?=[+(0-9])(?<![\p{{L}}\p{{N}}])(?:"
         rf"\+\d{{1,3}}{_GAP}?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:{_GAP}?\d{{2,4}}){{2,4}}"
         rf"|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}"
         rf"|\(0\d{{1,4}}\){_BLANK}?(?=\d(?:[ -]?\d){{4,7}}(?!\d))\d{{2,8}}(?:[ -]\d{{2,4}}){{0,3}}"
         rf")(?![\p{{L}}\p{{N}}])"
         rf"|(?=[0-9])(?<![\p{{L}}\p{{N}}+.,/-])(?:"
         rf"0[1-9](?:\d{{8}}|(?:{_BLANK}\d\d){{4}}|(?:\.\d\d){{4}}|(?:-\d\d){{4}})"
         rf"|0[1-9]\d{{1,3}}(?:{_BLANK}|[/-])(?=\d(?:[ -]?\d){{4,7}}(?!\d))\d{{2,8}}(?:[ -]\d{{2,4}}){{0,3}}"
         rf"|(?:1[ .-])?\d{{3}}(?:[.-]\d{{3}}[.-]|{_BLANK}\d{{3}}{_BLANK})\d{{4}}"
         rf"|[89]\d{_BLANK}\d{{3}}(?:{_BLANK}\d\d){{2}}|[6-9]\d\d(?:{_BLANK}\d\d){{3}}"
         rf")(?![\p{{L}}\p{{N}}-])")
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}-])"
ENTITY = "|".join([SECRET, EMAIL, PERSON, IP, PHONE, SSN, CARD])

_UNIT = "array<struct<type:string,raw:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _unit(kind, raw: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) or kind is None else kind
    return F.struct(kind.cast("string").alias("type"), raw.cast("string").alias("raw"))


def _script(part: Column) -> Column:
    return F.when(F.regexp_like(part, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")


def _name_units(raw: Column) -> Column:
    """A person's mention as units: title, then each name with its kind. The last name is
    the family name; those before it are given names of the title's gender."""
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.? ", 0)
    bare = F.regexp_replace(title, r"\.? $", "")
    gender = (F.when(bare.isin(MALE), "m").when(bare.isin(FEMALE), "f").otherwise("x"))
    parts = F.split(F.substr(raw, F.length(title) + 1), " ")
    units = F.flatten(F.transform(parts, lambda p, i: F.array(
        _unit(None, F.when(i > 0, " ").otherwise(title)),
        _unit(F.when(i == F.size(parts) - 1, F.concat(F.lit("family_"), _script(p)))
              .otherwise(F.concat(F.lit("given_"), gender, F.lit("_"), _script(p))), p))))
    return units


def _units(raw: Column, known: Column) -> Column:
    """The units of one match: literal text has no type. ``known`` are the typed names of
    the document, by which a bare later mention is told."""
    digits = _digits(raw)
    head = F.regexp_extract(raw, f"^{SECRET_HEAD}", 0)
    again = F.filter(known, lambda k: k["raw"] == raw)
    return (
        F.when(F.size(again) > 0, F.array(_unit(again[0]["type"], raw)))
        .when(head != "", F.array(
            _unit(None, head), _unit("secret", F.substr(raw, F.length(head) + 1))))
        .when(F.contains(raw, F.lit("@")), F.array(_unit("email", raw)))
        .when(F.regexp_like(raw, F.lit(rf"^(?:{_TITLE})\.? ")), _name_units(raw))
        .when(F.regexp_like(raw, F.lit(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")),
              F.array(_unit("ip", raw)))
        .when(F.regexp_like(raw, F.lit(r"^\d{3}-\d{2}-\d{4}$")), F.array(_unit("ssn", raw)))
        .when(F.regexp_like(raw, F.lit(f"^(?:{PHONE})$")), F.array(_unit("phone", raw)))
        # a long number is a card only if its check digit is right
        .when(F.call_function("luhn_check", digits),
              F.array(_unit("card", raw)))
        .otherwise(F.array(_unit(None, raw)))).cast(_UNIT)


def find_units(text: Column) -> Column:
    """A text as alternating literal and typed units that join to the text; null for a
    null text. A name met after a title is found again where it stands alone."""
    people = F.regexp_extract_all(text, F.lit(f"({PERSON})"), F.lit(1))

    def cut(names: Column) -> Column:
        known = F.filter(F.flatten(F.transform(names, _name_units)),
                         lambda u: u["type"].isNotNull() & (F.length(u["raw"]) > 1))

        def with_known(k: Column) -> Column:
            own = F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(
                k, lambda u: F.concat(F.lit("\\Q"), u["raw"], F.lit("\\E"))), "|"),
                F.lit(r")(?![\p{L}\p{N}])"))
            pattern = F.when(F.size(k) > 0, F.concat(F.lit(ENTITY), own)).otherwise(F.lit(ENTITY))
            found = F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
            gaps = F.split(text, pattern, -1)
            return let(found, lambda f: F.flatten(F.transform(gaps, lambda g, i: F.concat(
                F.array(_unit(None, g)).cast(_UNIT),
                F.when(i < F.size(f), _units(F.get(f, i), k))
                .otherwise(F.array().cast(_UNIT))))))

        return let(known, with_known)

    return let(people, cut)


def normal_form(kind: Column, raw: Column) -> Column:
    """What makes two mentions the same entity."""
    return (F.when(kind.isin("phone", "card", "ssn"), _digits(raw))
            .when(kind.isin("secret", "ip"), raw).otherwise(F.lower(raw)))


def _stream(kind: Column, norm: Column, draw: Column, key: str) -> Column:
    """Array of numbers from 0 to 65535, one for each character and eight more. The blocks
    hash a digest of the entity, so that a long one is read once."""
    def block(head: Column, b: Column) -> Column:
        h = F.sha2(F.concat_ws("|", head, b.cast("string")), 256)
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(
            F.substr(h, 4 * i + 1, F.lit(4)), 16, 10).cast("int"))

    blocks = F.sequence(F.lit(0), ((F.length(norm) + 8) / 16).cast("int"))
    head = F.concat_ws("|", F.lit(key), kind, draw.cast("string"), F.sha2(norm, 256))
    return let(head, lambda own: F.flatten(F.transform(blocks, lambda b: block(own, b))))


def _same_shape(text: Column, s: Column, hexed: Column) -> Column:
    """Every digit becomes a digit and every letter a letter of its case; other
    characters stay. With ``hexed`` letters stay within a to f."""
    def letter(n: Column) -> Column:
        return F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"),
                        n % F.when(hexed, 6).otherwise(26) + 1, F.lit(1))

    return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
        F.when(F.regexp_like(c, F.lit("[0-9]")), (s[i] % 10).cast("string"))
        .when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.upper(letter(s[i])))
        .when(F.regexp_like(c, F.lit(r"\p{L}")), letter(s[i])).otherwise(c))), "")


def _luhn_digit(body: Column) -> Column:
    """The check digit that completes ``body``."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(
            i % 2 == 0, F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int") + 1))
            .otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _name(kind: Column, s: Column, draw: Column) -> Column:
    """One name of the kind's list; later draws join two or more, up to 16, so none runs
    out."""
    lists = F.create_map(*[x for k, v in NAMES.items()
                           for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return let(F.element_at(lists, kind), lambda names: F.array_join(F.transform(
        F.sequence(F.lit(0), F.when(draw < 8, (draw / 4).cast("int")).otherwise(
            F.least(F.lit(15), draw - 6))),
        lambda i: names[s[i] % F.size(names)]), "-"))


def surrogate(kind: Column, norm: Column, draw: Column, key: str) -> Column:
    """The normal form of the replacement at the given draw."""
    # asked once, not for each character
    hex_secret = (kind == "secret") & F.regexp_like(norm, F.lit("^(?:[0-9a-f]++|[0-9A-F]++)$"))

    def drawn(s: Column, hexed: Column) -> Column:
        shaped = _same_shape(norm, s, hexed)
        # reserved for examples: the address can't be anyone's
        email = F.concat(F.regexp_replace(shaped, r"\.[^.@]*$", ""), F.lit(".example"))
        # characters for the later draws: a space of any size gets larger than the table
        more = F.array_join(F.transform(F.slice(s, 1, F.greatest(F.lit(0), F.least(
            F.lit(12), draw - OWN_SHAPE + 1))), lambda n: F.chr(n % 26 + 97)), "")
        digits = F.array_join(F.transform(F.slice(s, 1, F.greatest(F.lit(0), F.least(
            F.lit(12), draw - OWN_DIGITS + 1))), lambda n: (n % 10).cast("string")), "")
        code = F.greatest(F.length(norm) - 10, F.lit(0))
        code = F.when(norm.startswith("0"), F.greatest(code, F.lit(1))).otherwise(code)
        phone = F.concat(F.substr(norm, F.lit(1), code), F.substr(shaped, code + 1))
        card = F.concat(F.substr(norm, F.lit(1), F.lit(1)),
                        F.substr(shaped, F.lit(2), F.length(norm) - 2))
        ip = F.concat_ws(".", *[(s[i] % (223 if i == 0 else 256) + int(i == 0)).cast("string")
                                for i in range(4)])
        ip = F.when(digits != "", F.concat(ip, F.lit(":"), digits)).otherwise(ip)
        card = F.concat(card, digits)
        return (F.when(kind == "email", F.concat(more, email))
                .when(kind == "phone", F.concat(phone, digits))
                .when(kind == "card", F.concat(card, _luhn_digit(card)))
                .when(kind == "ip", ip)
                .when(kind == "ssn", F.concat(F.lit("9"), F.substr(shaped, F.lit(2)), digits))
                .when(kind == "secret", F.concat(shaped, more))
                .otherwise(F.lower(_name(kind, s, draw))))

    return let(_stream(kind, norm, draw, key), lambda s: let(hex_secret, lambda h: drawn(s, h)))


def written_like(kind: Column, raw: Column, new: Column) -> Column:
    """The replacement in the format of the mention: digits in its places (further ones
    after them), names in its case."""
    def numbers() -> Column:
        return F.concat(F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(
            F.regexp_like(c, F.lit("[0-9]")),
            F.substr(new, F.length(_digits(F.substr(raw, F.lit(1), i + 1))), F.lit(1)))
            .otherwise(c)), ""), F.substr(new, F.length(_digits(raw)) + 1))

    shouted = (F.length(raw) > 1) & (raw == F.upper(raw))
    named = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
    return (F.when(kind.isin("phone", "card", "ssn"), numbers())
            .when(kind.isin("secret", "ip"), new)
            .when(kind == "email", F.when(shouted, F.upper(new)).otherwise(new))
            .when(shouted, F.upper(new)).otherwise(named))


def assign_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``(type, norm, new)`` for the entities ``(type, norm)``: different entities of one
    type have different replacements, and no replacement is an entity of the table.

    In each round the open entities draw; of those with the same draw the smallest
    keeps it, unless an entity or an earlier round has it; the others draw again. Later
    draws are longer, so every entity finds one. Only whether any are open reaches the
    driver.
    """
    every = materialize(entities.select("type", "norm").distinct(), "pii-entities")
    taken = every.select("type", F.col("norm").alias("new"))
    open_, done, draw = every, [], 0
    while True:
        drawn = materialize(open_.withColumn(
            "new", surrogate(F.col("type"), F.col("norm"), F.lit(draw), key)), "pii-draws")
        first = drawn.groupBy("type", "new").agg(F.min("norm").alias("norm"))
        kept = materialize(first.join(taken, ["type", "new"], "left_anti")
                           .select("type", "norm", "new"), "pii-kept")
        done.append(kept)
        taken = taken.unionByName(kept.select("type", "new"))
        open_ = drawn.drop("new").join(kept.select("type", "norm"), ["type", "norm"], "left_anti")
        if open_.isEmpty():
            break
        draw += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def replace_pii(docs: DataFrame, text: str = "text", key: str = KEY,
                entities: str | None = None) -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced; all other columns and
    characters stay, and a text without entities is unchanged. With ``entities`` a
    column of that name holds the number of replaced units.

    Only the texts that hold an entity are taken apart and put together again; null
    and empty texts stay as they are. Row order is not kept.
    """
    uid, cut = "__row", "__units"
    marked = materialize(docs.withColumns({cut: find_units(F.col(text))}).withColumns({
        cut: F.when(F.exists(cut, lambda u: u["type"].isNotNull()), F.col(cut)),
        uid: F.monotonically_increasing_id()}), "pii-docs")
    hit = marked.where(F.col(cut).isNotNull())
    units = hit.select(uid, F.posexplode(cut).alias("at", "u")).select(
        uid, "at", "u.type", "u.raw").withColumn("norm", normal_form(F.col("type"), F.col("raw")))
    typed = units.where("type IS NOT NULL")
    table = assign_surrogates(typed)
    new = typed.join(table, ["type", "norm"]).select(
        uid, "at", written_like(F.col("type"), F.col("raw"), F.col("new")).alias("out"),
        F.lit(1).alias("n"))
    plain = units.where("type IS NULL").select(uid, "at", F.col("raw").alias("out"),
                                               F.lit(0).alias("n"))
    joined = new.unionByName(plain).groupBy(uid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))),
                                 lambda x: x["out"]), "").alias("__text"),
        F.sum("n").alias("__n"))
    count = [] if entities is None else [entities]
    cols = [c for c in docs.columns if c not in count]
    changed = hit.join(joined, uid).select(
        *[F.col("__text").alias(c) if c == text else F.col(c) for c in cols],
        *[F.col("__n").alias(c) for c in count])
    same = marked.where(F.col(cut).isNull()).select(
        *cols, *[F.lit(0).cast("long").alias(c) for c in count])
    return changed.unionByName(same)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets, and the number of
    replaced units.

    Null and empty texts stay as they are; repeated rows come out alike, each with its
    entities replaced by the same surrogates as everywhere; very long texts are whole; an
    empty table gives no rows. Other columns of the table are not read."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return replace_pii(docs, entities="n_replaced")
