"""Turkish inflection as native column functions: vowel harmony, case suffixes, verb endings, copula."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.text import PUNCTUATION, capitalised, lower_tr, trimmed

VOWELS = "aeıioöuü"
_ANY_VOWEL = "aeıioöuüAEIİOÖUÜ"
_UNVOICED = "fstkçşhpFSTKÇŞHP"
#: Verb stems in the order in which they are tried.
VERB_STEMS = (
    "sağla", "et", "engelle", "önle", "kullan", "incele", "hesapla", "bulun", "çalış",
    "tanımla", "oluştur", "yönet", "yaz", "oku", "çöz", "geliştir", "destekle", "göster",
    "yap", "arttır", "azalt", "sil", "ekle", "güncelle", "başlat", "bitir", "yükle", "kaydet",
    "temizle", "duraklat", "devam", "seç", "geç", "gir", "çık", "ver", "al", "işle", "üret",
)
#: Verbs whose present takes a narrow vowel though they have one syllable.
NARROW_VERBS = ("et", "al", "ver", "bul", "gel", "gör", "kal", "ol", "dur", "vur")


def last_vowel(word: Column) -> Column:
    """The last vowel, in lower case; two names are pronounced otherwise than they are written. Null if there is none."""
    found = F.regexp_extract(word, f"([{_ANY_VOWEL}])[^{_ANY_VOWEL}]*$", 1)
    found = F.translate(found, "AEIİOÖUÜ", "aeıioöuü")
    return F.when(lower_tr(word) == "rust", "a").when(lower_tr(word) == "wgpu", "u").when(found != "", found)


def ends_with_vowel(word: Column) -> Column:
    return word.rlike(f"[{_ANY_VOWEL}]$")


def ends_unvoiced(word: Column) -> Column:
    return word.rlike(f"[{_UNVOICED}]$")


def hardened(stem: Column) -> Column:
    """The final consonant as it is without a suffix."""
    return F.concat(F.regexp_replace(stem, "(?s).$", ""), F.translate(F.right(stem, F.lit(1)), "ğdbc", "ktpç"))


def softened(word: Column) -> Column:
    """The final consonant as it is before a vowel."""
    return F.concat(F.regexp_replace(word, "(?s).$", ""), F.translate(F.right(word, F.lit(1)), "ktpç", "ğdbc"))


def narrow_vowel(vowel: Column) -> Column:
    """ı, u, i or ü in harmony."""
    return F.when(vowel.isin("a", "ı"), "ı").when(vowel.isin("o", "u"), "u").when(vowel.isin("ö", "ü"), "ü").otherwise("i")


def wide_vowel(vowel: Column) -> Column:
    """a or e in harmony."""
    return F.when(vowel.isin("a", "ı", "o", "u"), "a").otherwise("e")


def with_case(word: Column, case: Column) -> Column:
    """word with the suffix for case -i, -e, -de, -den, -in or -ler; after an apostrophe for names."""
    vowel = F.coalesce(last_vowel(word), F.lit("e"))
    after_vowel = ends_with_vowel(word)
    dental = F.when(ends_unvoiced(word), "t").otherwise("d")
    link = lambda letter: F.when(after_vowel, letter).otherwise("")
    suffix = (
        F.when(case == "-i", F.concat(link("y"), narrow_vowel(vowel)))
        .when(case == "-e", F.concat(link("y"), wide_vowel(vowel)))
        .when(case == "-de", F.concat(dental, wide_vowel(vowel)))
        .when(case == "-den", F.concat(dental, wide_vowel(vowel), F.lit("n")))
        .when(case == "-in", F.concat(link("n"), narrow_vowel(vowel), F.lit("n")))
        .when(case == "-ler", F.concat(F.lit("l"), wide_vowel(vowel), F.lit("r")))
        .otherwise("")
    )
    name = word.rlike(r"^\p{Lu}|\p{N}|[wqxWQX]")
    soft = case.isin("-i", "-e", "-in") & ~after_vowel
    return F.when(word == "", word).when(name, F.concat(word, F.lit("'"), suffix)).otherwise(F.concat(F.when(soft, softened(word)).otherwise(word), suffix))


def with_tense(verb: Column, ending: Column) -> Column:
    """verb with -meli (should), -di (past), or else the present."""
    vowel = F.coalesce(last_vowel(verb), F.lit("e"))
    dental = F.when(ends_unvoiced(verb), "t").otherwise("d")
    syllables = F.length(F.regexp_replace(verb, f"[^{_ANY_VOWEL}]", ""))
    narrow = (syllables > 1) | verb.isin(*NARROW_VERBS)
    present = (
        F.when(verb.rlike(f"[{VOWELS}]$"), F.concat(verb, F.lit("r")))
        .when(verb == "et", "eder")
        .otherwise(F.concat(verb, F.when(narrow, narrow_vowel(vowel)).otherwise(wide_vowel(vowel)), F.lit("r")))
    )
    should = F.concat(verb, F.when(wide_vowel(vowel) == "a", "malı").otherwise("meli"))
    return F.when(ending == "-meli", should).when(ending == "-di", F.concat(verb, dental, narrow_vowel(vowel))).otherwise(present)


def with_copula(word: Column) -> Column:
    dental = F.when(ends_unvoiced(word), "t").otherwise("d")
    return F.when(word == "", word).otherwise(F.concat(word, dental, narrow_vowel(F.coalesce(last_vowel(word), F.lit("e"))), F.lit("r")))


def sentence_with_copula(sentence: Column) -> Column:
    """The copula on the last word, unless it has one already, or is a verb or a slot. Blanks become single where it is added."""
    words = F.filter(F.split(sentence, r"(?U)\s+"), lambda w: w != "")
    last = F.regexp_replace(F.element_at(words, -1), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")
    needs = (last != "") & ~last.rlike("(d|t)[iıuü]r$") & ~last.isin(*VERB_STEMS)
    return F.when((F.size(words) > 0) & needs, F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(with_copula(last))), " ")).otherwise(sentence)


def finished(sentence: Column, lang: Column, ends_in_verb: Column) -> Column:
    """Trimmed, with the copula where Turkish needs it, a capital and a full stop."""
    plain = trimmed(sentence)
    full = capitalised(F.when((lang == "tr") & ~ends_in_verb, sentence_with_copula(plain)).otherwise(plain))
    return F.when(plain == "", plain).when(full.rlike(r"[.!?]$"), full).otherwise(F.concat(full, F.lit(".")))


def realised(subjects: Column, objects: Column, verbs: Column, template: Column, lang: Column) -> Column:
    """A sentence from a template of slots: nouns by slot in turn, the other list where one is used up, then stock words.

    subjects, objects and verbs are arrays of strings, best first. English is not inflected. A row without template gives ''.
    """
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("o"), F.lit(0).alias("v"), F.array().cast("array<string>").alias("out"))
    at = lambda items, i: F.get(items, i)

    def add(acc: Column, part: Column) -> Column:
        slot = F.regexp_extract(part, r"^\[(Özne|Nesne|Eylem)\]", 1)
        ending = F.regexp_extract(part, "-(.*)$", 0)
        s, o, v = acc["s"], acc["o"], acc["v"]
        more_s, more_o = s < F.size(subjects), o < F.size(objects)
        take_s = F.when(slot == "Özne", more_s).when(slot == "Nesne", ~more_o & more_s).otherwise(False)
        take_o = F.when(slot == "Nesne", more_o).when(slot == "Özne", ~more_s & more_o).otherwise(False)
        noun = F.when(take_s, at(subjects, s)).when(take_o, at(objects, o)).otherwise(F.when(slot == "Özne", "sistem").otherwise("veri"))
        verb = F.coalesce(F.regexp_replace(at(verbs, v), r"^[\[\]]+|[\[\]]+$", ""), F.lit("sağla"))
        word = (
            F.when(slot.isin("Özne", "Nesne"), F.when((ending == "") | (lang == "en"), noun).otherwise(with_case(noun, ending)))
            .when(slot == "Eylem", F.when(lang == "en", verb).otherwise(with_tense(verb, F.when(ending == "", "-r").otherwise(ending))))
            .otherwise(part)
        )
        plus = lambda n, when: n + F.when(when, 1).otherwise(0)
        return F.struct(plus(s, take_s).alias("s"), plus(o, take_o).alias("o"), plus(v, slot == "Eylem").alias("v"), F.array_append(acc["out"], word).alias("out"))

    parts = F.transform(F.split(template, r"\+"), trimmed)
    sentence = F.aggregate(parts, start, add, lambda acc: F.array_join(acc["out"], " "))
    return F.when(template == "", "").when(sentence == "", "").otherwise(F.concat(capitalised(sentence), F.lit(".")))

