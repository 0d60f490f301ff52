"""Unit facts of the column functions."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import markup, turkish
from weftgraph.functions import text as T

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


FACTS = [
    (lambda: turkish.last_vowel(L("hafıza")), "a"),
    (lambda: turkish.last_vowel(L("güvenlik")), "i"),
    (lambda: turkish.last_vowel(L("krt")), None),
    (lambda: turkish.with_case(L("hafıza"), L("-e")), "hafızaya"),
    (lambda: turkish.with_case(L("güvenlik"), L("-i")), "güvenliği"),
    (lambda: turkish.with_case(L("kitap"), L("-den")), "kitaptan"),
    (lambda: turkish.with_case(L("wgpu"), L("-e")), "wgpu'ya"),
    (lambda: turkish.with_case(L(""), L("-e")), ""),
    (lambda: turkish.with_tense(L("et"), L("-r")), "eder"),
    (lambda: turkish.with_tense(L("engelle"), L("-meli")), "engellemeli"),
    (lambda: turkish.with_tense(L("çalış"), L("-di")), "çalıştı"),
    (lambda: turkish.finished(L(" bu bir kitap"), L("tr"), L(False)), "Bu bir kitaptır."),
    (lambda: turkish.finished(L("all of it"), L("en"), L(False)), "All of it."),
    (lambda: turkish.finished(L("  "), L("tr"), L(False)), ""),
    (lambda: T.part_from_title(L("Kuantum Fiziği")), "kuantum_fizigi"),
    (lambda: T.part_from_title(L("  Yapay Zeka--Modeli ")), "yapay_zeka_modeli"),
    (lambda: T.part_from_title(L("İzmir")), "izmir"),
    (lambda: T.part_from_title(L("!?")), "general"),
    (lambda: T.part_from_filename(L("VM 2. Hafta.pdf")), "vm_2_hafta"),
    (lambda: T.part_from_filename(L("rust_what_is_ownership.txt")), "ownership"),
    (lambda: T.part_from_filename(L("rust_references_and_borrowing.txt")), "borrowing"),
    (lambda: T.part_from_filename(L("rust_programming_language.txt")), "rust"),
    (lambda: T.is_page_number(L("Page 10 of 20")), True),
    (lambda: T.is_page_number(L("12/45")), True),
    (lambda: T.is_page_number(L("Rust Programlama")), False),
    (lambda: T.is_contents_line(L("Bölüm 2 ..... 12")), True),
    (lambda: T.is_contents_line(L("Bu bir normal cümledir.")), False),
    (lambda: T.is_collapsed_layout(L("#$")), True),
    (lambda: T.is_collapsed_layout(L("")), True),
    (lambda: T.is_collapsed_layout(L("Rust hafıza güvenliğini sağlar.")), False),
    (lambda: T.capped_symbols(L("text ------ test")), "text ---- test"),
    (lambda: T.node_kind(L(" fn main()")), "Code"),
    (lambda: T.node_kind(L("+")), "Operator"),
    (lambda: T.node_kind(L("1+2-3")), "Equation"),
    (lambda: T.answer_mode(L("!x")), "deterministic"),
    (lambda: T.answer_mode(L("hayat nasil")), "creative"),
    (lambda: T.words_of(L("Ab I, ı c d-e _x")), ["ab", "ı", "ı", "d-e", "_x"]),
    (lambda: T.chunks(L("ab. Hello there; " + "x" * 160 + " tail")), ["Hello there", "x" * 160, "tail"]),
    (lambda: T.chunks(L("")), []),
    (lambda: markup.link_texts(L("[[Dosya:küçükresim|sağ|HERA]]")), "HERA"),
    (lambda: markup.link_texts(L("[[Dosya:Hera.jpg|küçükresim|sağ]]")), ""),
    (lambda: markup.link_texts(L("[[Kategori:Fizik]]")), ""),
    (lambda: markup.link_texts(L("[[Kuantum mekaniği|Kuantum]] a [[b")), "Kuantum a b"),
    (lambda: markup.without_nested(L("a}}b{{c{{d}}e}}f{{g"), r"\{\{", r"\}\}"), "abf"),
    (lambda: markup.without_back_matter(L("text ==Dış Bağlantılar== more")), "text "),
    (lambda: markup.without_back_matter(L("text == KAYNAKÇA == more")), "text "),
    (lambda: markup.without_tags(L("a<b>c</b>d>e<f")), "acde"),
    (lambda: markup.plain_wiki(L("== Giriş ==\n[[Kuantum kuramı]] {{x {{y}} z}}b<ref>q</ref>")), "Giriş Kuantum kuramı b"),
]


@pytest.mark.parametrize("k", range(len(FACTS)))
def test_fact(spark, k):
    column, expected = FACTS[k]
    assert value(spark, column()) == expected


def test_realised_template(spark):
    words = lambda *x: F.array(*map(L, x))
    made = turkish.realised(words("Rust"), words("güvenlik"), words("[sağla]"), L("[Özne] + [Nesne]-i + [Eylem]-r"), L("tr"))
    assert value(spark, made) == "Rust güvenliği sağlar."
