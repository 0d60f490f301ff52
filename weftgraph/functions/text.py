"""Text predicates and normalisers as native column functions.

Two lower-casings exist and never mix: lower_tr (dotted and dotless i, for tokens and stems) and plain lower (for part names,
concept tags, routing words and mode detection). Length limits are in UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that matching folds, and what they become.
FOLD_FROM, FOLD_TO = "ığüşöçĞÜŞÖÇ", "igusocGUSOC"
#: Parts that are never routed to, evicted or re-clustered.
RESERVED_PARTS = ("core_language", "general")
#: Template slots and roles.
SUBJECT, OBJECT, VERB = "[Özne]", "[Nesne]", "[Eylem]"
ROLE_SUBJECT, ROLE_OBJECT = "Özne", "Nesne"

#: A query with one of these as a substring asks for facts.
FACT_WORDS = ("nedir", "kimdir", "nelerdir", "açıkla", "ne demek", "tanımı")
#: A query with one of these as a substring is technical.
TECHNICAL_WORDS = (
    "fn", "let", "struct", "impl", "cargo", "unsafe", "mut", "pub", "match",
    "main", "loop", "crate", "math", "matrix", "equation", "algebra", "algorithm",
    "big o", "sorting", "binary", "boolean", "logical", "compile", "error", "rendering",
    "wgpu", "pointer", "reference", "vector", "türev", "integral", "limit",
    "başlat", "çalıştır", "yap", "run", "start", "execute", "init", "kodla", "yaz", "oluştur",
    "code", "write", "create", "rust", "projects",
)
#: Words that vote for English, and for Turkish.
ENGLISH_WORDS = (
    "the", "of", "and", "to", "in", "is", "you", "that", "it", "he", "was", "for",
    "on", "are", "as", "with", "his", "they", "at", "be", "this", "have", "from",
    "not", "by", "or", "but", "an", "your", "which", "their", "will",
)
TURKISH_WORDS = (
    "ve", "veya", "ile", "için", "göre", "tarafından", "bir", "bu", "o", "da", "de",
    "ki", "ama", "fakat", "lakin", "ise", "en", "daha", "her", "gibi", "yok", "var",
    "kendi", "biz", "siz", "onlar", "bunu", "buna", "bunda", "bundan",
)
#: ASCII punctuation, for use inside a character class.
PUNCTUATION = r"!-/:-@\[-`{-~"
SHORTEST, LONGEST = 5, 150


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lower_tr(text: Column) -> Column:
    return F.lower(F.translate(text, "İI", "iı"))


def folded(text: Column) -> Column:
    """For matching: lower case, Turkish letters as their plain neighbours."""
    return F.translate(lower_tr(text), FOLD_FROM, FOLD_TO)


def words_of(text: Column) -> Column:
    """Lower-case words of letters, `_`, `$` and `-`, of two bytes or more."""
    return F.filter(F.split(lower_tr(text), r"[^\p{IsAlphabetic}_$-]"), lambda w: F.octet_length(w) > 1)


def routing_words(text: Column) -> Column:
    """Plain lower-case words between blanks and `?!.,`, of two bytes or more."""
    return F.filter(F.split(F.lower(text), r"(?U)[\s?!.,]"), lambda w: F.octet_length(w) > 1)


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Sentence pieces: text between `.?!;` and line ends, of shortest to longest bytes; longer ones are packed word by word.

    Shorter pieces are dropped, but not what is left over from packing. A word that fills a chunk stays whole.
    """

    def packed(piece: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def add(acc: Column, word: Column) -> Column:
            full = F.octet_length(acc["open"]) + F.octet_length(word) + 1 > longest
            done = F.when(full & (acc["open"] != ""), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
            joined = F.when(full | (acc["open"] == ""), word).otherwise(F.concat(acc["open"], F.lit(" "), word))
            return F.struct(done.alias("done"), joined.alias("open"))

        words = F.filter(F.split(piece, r"(?U)\s+"), lambda w: w != "")
        return F.aggregate(words, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))

    pieces = F.transform(F.split(text, r"[.?!\n;]"), trimmed)
    size = F.octet_length
    kept = F.filter(pieces, lambda p: size(p) >= shortest)
    return F.flatten(F.transform(kept, lambda p: F.when(size(p) <= longest, F.array(p)).otherwise(packed(p))))


def is_code(text: Column, trim: bool = True) -> Column:
    # How code begins, and what only code holds.
    t = trimmed(text) if trim else text
    return t.rlike(r"^((fn|let|struct|impl|use|pub|\$|>) )") | t.contains("println!") | (t.contains("{") & t.contains("}") & t.contains("\n"))


def is_operator(text: Column) -> Column:
    return trimmed(text).isin("+", "-", "*", "/", "=")


def is_equation(text: Column) -> Column:
    t = trimmed(text)
    return t.contains("=") | ((F.length(F.regexp_replace(t, r"[^+*/-]", "")) >= 2) & t.rlike("[0-9]"))


def node_kind(text: Column) -> Column:
    return F.when(is_code(text), "Code").when(is_operator(text), "Operator").when(is_equation(text), "Equation").otherwise("Concept")


def is_template(text: Column) -> Column:
    return text.contains(" + ") | text.contains(SUBJECT) | text.contains(OBJECT) | text.contains(VERB)


def answer_mode(query: Column) -> Column:
    """`deterministic` for queries that are forced, hold a sign of arithmetic, or a fact or technical word; else `creative`."""
    q = F.lower(query)
    found = q.rlike(r"^(\[det\]|!)|[-+*/=<>%]|" + "|".join(FACT_WORDS + TECHNICAL_WORDS))
    return F.when(found, "deterministic").otherwise("creative")


def without_punctuation(word: Column, keep: str = r"'\[\]") -> Column:
    """Without ASCII punctuation at either end, but for keep."""
    marks = f"[{PUNCTUATION}&&[^{keep}]]" if keep else f"[{PUNCTUATION}]"
    return F.regexp_replace(word, f"^{marks}+|{marks}+$", "")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def _name(text: Column) -> Column:
    """Letters, digits and single underscores; none at the ends."""
    plain = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}_]", "")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")


def part_from_title(title: Column) -> Column:
    plain = F.translate(F.regexp_replace(F.lower(title), "i̇", "i"), FOLD_FROM, FOLD_TO)
    name = _name(F.translate(plain, " -", "__"))
    return F.when(name == "", "general").otherwise(name)


def part_from_filename(name: Column) -> Column:
    """A part name, grouped by known topics. The last extension and a leading `rust_` go first."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[^.]*$", ""), "^rust_", "")
    clean = _name(F.translate(stem, " ", "_"))
    # Topics in their order, and the part for each.
    topics = (
        ("ownership", "ownership"), ("borrowing", "borrowing"), ("reference", "borrowing"), ("slice", "slices"),
        ("guessing_game", "guessing_game"), ("", "rust"), ("hellocargo", "cargo"), ("helloworld", "hello_world"),
        ("control_flow", "control_flow"), ("data_types", "data_types"), ("comments", "comments"),
        ("functions", "functions"), ("quantum_physics", "quantum"),
    )
    out = F
    for topic, part in topics:
        out = out.when(clean.contains(topic) if topic else clean == "programming_language", part)
    return out.otherwise(clean)


def is_page_number(line: Column) -> Column:
    digits = line.rlike(r"(?U)^[0-9\s/-]*[0-9][0-9\s/-]*$") & (F.octet_length(line) <= 10)
    return digits | F.lower(line).rlike("^(sayfa|page)")


def is_contents_line(line: Column) -> Column:
    return line.contains("..") | (F.length(F.regexp_replace(line, r"[^.]", "")) >= 5)


def is_collapsed_layout(line: Column) -> Column:
    t = trimmed(line)
    odd = F.length(F.regexp_replace(t, r"(?U)[\p{IsAlphabetic}\p{N}\s'.,?!\-+*/=]", ""))
    short = (F.octet_length(t) < 3) & ~t.rlike(r"^[\p{IsAlphabetic}\p{N}]*$")
    return (t == "") | short | (odd / F.octet_length(t) > 0.35)


def capped_symbols(line: Column) -> Column:
    """Without control characters, and with runs of one symbol cut to four."""
    plain = F.regexp_replace(line, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.regexp_replace(plain, r"(?U)([^\p{IsAlphabetic}\p{N}\s])\1{4,}", "$1$1$1$1")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
