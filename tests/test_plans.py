from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cutlight.operators.text_search import keep_wildcards, text_rows, vocabulary
from cutlight.plans import planner as pl
from cutlight.plans import search as se

NOW = datetime(2026, 9, 5, 12)
LEX = pl.Lexicon([("playera", "t-shirt"), ("playera azul", "blue t-shirt"), ("hombre", "man"), ("mujer", "woman"), ("luz", "light"), ("lentes", "glasses")])


@pytest.mark.parametrize("query,want", [
    ("marzo 2025", (datetime(2025, 3, 1), datetime(2025, 3, 31, 23, 59, 59))), ("2024", (datetime(2024, 1, 1), datetime(2024, 12, 31, 23, 59, 59))),
    ("el año pasado", (datetime(2025, 1, 1), datetime(2025, 12, 31, 23, 59, 59))), ("this year", (datetime(2026, 1, 1), datetime(2026, 12, 31, 23, 59, 59))),
    ("hace 3 semanas", (datetime(2026, 8, 8, 12), datetime(2026, 8, 22, 12))), ("two days ago", (datetime(2026, 9, 2, 12), datetime(2026, 9, 4, 12))),
    ("hace un dia", (datetime(2026, 9, 3, 12), NOW)), ("comienza hasta junio", None), ("hace rato", None), ("", None),
])
def test_dates(query, want):
    assert pl.date_intent(query, NOW) == want


def test_media():
    assert [pl.media_intent(q) for q in ("fotos del mar", "fotos y videos", "un podcast", "voice memo", "mar")] == ["image", None, "audio", None, None]


def test_terms():
    assert pl.literal_terms('busca "no había presupuesto" toma camara azul azul') == ["no había presupuesto", "toma", "camara", "azul"]
    assert [pl.describable(q) for q in ("IMG_0042", "toma 7", "hombre", "el de la", "A004C012")] == [False, False, True, False, False]
    assert pl.label_terms(["A photo of a duck", "duck pond"]) == ["duck", "pond"]
    assert pl.says_nothing(" None. ") and not pl.says_nothing("noon")


def test_lexicon():
    assert LEX.translate("hombre con playera azul y lentes") == "man blue t shirt glasses".replace("t shirt", "t-shirt")
    assert LEX.translate("luces mujeres") == "lights womans" and pl.spanish_plural("luz") == "luces" and pl.english_plural("city") == "cities"
    assert LEX.looks_spanish("el mar") and not LEX.looks_spanish("blue sea") and LEX.needs_translation("hombre walking") and not LEX.needs_translation("a very long english phrase hombre")


def test_tiers():
    def broken(q):
        raise RuntimeError

    plan = pl.plan_query("hombre 2024", LEX, NOW, (broken, lambda q: None))
    assert plan.visual == ("man 2024", "hombre 2024") and plan.source == "lexicon" and plan.created[0].year == 2024
    made = pl.plan_query("mujer", LEX, NOW, (lambda q: pl.SearchPlan(q, ("none", "una mujer", "woman"), ("hola", "x")),))
    assert made.visual == ("woman",) and made.spoken == ("mujer", "hola")
    assert pl.plan_query("IMG_0042", LEX, NOW).visual == ()


def test_cache():
    c, made = pl.RecentCache(2), []
    for p in ("a", "A ", "b", "c", "a"):
        c.get([p], lambda k: made.append(k) or k)
    assert made == [("a",), ("b",), ("c",), ("a",)]


def test_reranked(table):
    r = table("position int, asset_id bigint, moment_id bigint, confidence double, score double", (1, 1, 10, 0.9, 0.9), (2, 2, 20, 0.8, 0.8), (3, 3, 30, 0.7, 0.7))
    out = se.reranked(r, table("moment_id bigint, confidence2 double", (10, 0.0), (30, 1.0)), 0.5)
    assert [(x.position, x.moment_id, round(x.confidence, 3)) for x in out.orderBy("position").collect()] == [(1, 30, 0.85), (2, 20, 0.8), (3, 10, 0.45)]


def test_lexicon_takes_the_longest_phrase():
    lex = pl.Lexicon([("coche", "car"), ("coche rojo", "red car"), ("puesta de sol", "sunset")])
    assert lex.translate("un coche rojo en la puesta de sol y coches") == "red car sunset cars" and pl.Lexicon([]).translate("hola") == "hola"
    assert pl.Lexicon(pl.WORDS).translate("Ríos de noche") == "rivers night"


def test_search_end_to_end(table):
    text = table(
        "row_id bigint, asset_id bigint, moment_id bigint, kind string, text string, start_seconds double, end_seconds double",
        (1, 3, None, "transcript", "hablamos del presupuesto anual", 856.0, 864.0), (2, 2, None, "transcript", "el presupuesto", 12.0, 20.0),
        (3, 2, None, "filename", "presupuesto final", None, None), (4, 9, None, "transcript", "otra cosa", 0.0, 1.0), (5, 8, None, "unknown", "presupuesto", 0.0, 1.0),
    )
    assets = table("asset_id bigint, display_name string, media_type string, created_at timestamp", *((i, f"f{i}", "video", None) for i in (1, 2, 3, 8, 9)))
    moments = table("moment_id bigint, asset_id bigint, start_seconds double, end_seconds double, embedding array<float>", (11, 1, 840.0, 870.0, [1.0, 0.0]), (12, 3, 840.0, 870.0, [1.0, 0.0]), (13, 9, 0.0, 1.0, [0.0, 1.0]))
    plan = pl.lexicon_plan("presupuesto", LEX, NOW)
    patterns = keep_wildcards(vocabulary(text_rows(text, "row_id", "text")), list(plan.literal))
    assert patterns == ["presupuesto*"]
    phases = list(se.progressive(plan, text, assets, patterns, moments, F.array(F.lit(1.0), F.lit(0.0))))
    assert [(n, f) for n, f, _ in phases] == [("fast", False), ("refined", True)]
    assert {r.asset_id for r in phases[0][2].collect()} == {2, 3}
    refined = phases[1][2].orderBy("position").collect()
    assert {r.asset_id for r in refined} == {1, 2, 3} and refined[0].confidence >= refined[-1].confidence and set(refined[0].ranks) >= {"visual"}
    locations = table("location_id bigint, asset_id bigint, volume_uuid string, relative_path string, availability string", (1, 3, "v", "p", "offline"))
    full = {r.asset_id: r for r in se.hydrate(phases[1][2], assets, locations, table("volume_uuid string, is_online boolean", ("v", False))).collect()}
    assert full[3].availability == "offline" and full[1].location_id is None and len(full) == 3


def test_surprise(table):
    m = table("moment_id bigint, asset_id bigint, start_seconds double, end_seconds double, embedding array<float>", *((i, i, 0.0, 1.0, [0.01, 1.0]) for i in range(30)), (99, 99, 0.0, 1.0, [1.0, 0.0]))
    got = se.visual_candidates(m, F.array(F.lit(1.0), F.lit(0.0)), se.Options(), by_surprise=True).collect()
    assert [r.moment_id for r in got] == [99] and 0 < got[0].confidence <= 1
