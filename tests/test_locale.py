"""Values by locale: another language's words, their weights, the chain of fallbacks, and errors."""

import pytest

from rowloom import api, cli, config
from rowloom.errors import ConfigInvalid
from rowloom.functions import corpora
from rowloom.operators import generate
from rowloom.schema import Column, Kind, Schema, Table

KEY = Column("id", Kind.INTEGER, nullable=False, auto_increment=True)
PEOPLE = Schema.of(
    Table("people", (KEY, *(Column(c, Kind.TEXT, nullable=False) for c in ("full_name", "email", "phone", "street", "title_text", "description")), Column("first_name", Kind.TEXT, nullable=False), Column("last_name", Kind.TEXT, nullable=False), Column("gender", Kind.TEXT, nullable=False)), ("id",)),
    Table("shops", (KEY, *(Column(c, Kind.TEXT, nullable=False) for c in ("city", "state", "zip_code", "country"))), ("id",)),
)


def made(spark, locale, n=600):
    return {k: df.collect() for k, df in api.seed(spark, PEOPLE, count=n, locale=locale).tables.items()}


def test_another_language(spark):
    en, de = made(spark, "en"), made(spark, "de")
    for c in ("full_name", "email", "phone", "street", "description", "first_name", "last_name"):
        assert not {r[c] for r in en["people"]} & {r[c] for r in de["people"]} or c in ("first_name",), c
    german = corpora.CORPORA["de"]
    for r in de["people"]:
        assert r["last_name"] in german["last"] and r["first_name"] in german["first_f" if r["gender"] == "female" else "first_m"]
        assert r["email"].isascii() and r["email"].split("@")[1].startswith("example.") and r["phone"].startswith("+49-30-23125-")
    places = {(c, s): lead for c, s, lead, _ in german["place"]}
    for r in de["shops"]:
        assert r["zip_code"].startswith(places[r["city"], r["state"]]) and len(r["zip_code"]) == 5
    # What German has no words for is English.
    assert {r["country"] for r in de["shops"]} == {r["country"] for r in en["shops"]}


def test_weights_make_the_first_words_common(spark):
    last = [r["last_name"] for r in made(spark, "de", 3000)["people"]]
    words = corpora.CORPORA["de"]["last"]
    share = corpora.weights(len(words))
    for k in (0, 1, len(words) - 1):
        expected = share[k] / sum(share)
        assert abs(last.count(words[k]) / 3000 - expected) < 4 * (expected / 3000) ** 0.5


def test_regions_fall_back_to_their_language(spark):
    at = made(spark, "de_AT", 100)
    austrian = {p[0] for p in corpora.CORPORA["de-AT"]["place"]}
    assert {r["city"] for r in at["shops"]} <= austrian and all(len(r["zip_code"]) == 4 for r in at["shops"])
    assert {r["last_name"] for r in at["people"]} <= set(corpora.CORPORA["de"]["last"]) and at["people"][0]["phone"].startswith("+43-1-")
    assert corpora.chain("de_at") == ["de-AT", "de", "en"] and corpora.chain("en-GB") == ["en-GB", "en"] and corpora.entries("en-GB", "last") is None
    t = corpora.table(spark, ["de-AT", "fr"])
    assert t.where("locale = 'de-AT' and kind = 'last'").count() == len(corpora.CORPORA["de"]["last"]) and t.where("kind = 'place' and value = 'Wien'").count() == 1


def test_unknown_locales_raise(spark, capsys):
    for bad in ("xx", "deutsch", ""):
        with pytest.raises(ConfigInvalid):
            api.seed(spark, PEOPLE, count=1, locale=bad)
        with pytest.raises(ConfigInvalid):
            config.validate({"locale": bad})
    with pytest.raises(ConfigInvalid):
        config.validate({"locale": 7})
    assert config.generation_config(config.validate({"locale": "fr"})).locale == "fr" and generate.Config(locale="FR_ca").locale == "fr-CA"


def test_every_locale_has_every_kind():
    kinds = {k for x in corpora.CORPORA.values() for k in x}
    for locale in corpora.CORPORA:
        for k in kinds:
            assert corpora.entries(locale, k), (locale, k)
            assert len(corpora.entries(locale, k)) == len(set(corpora.entries(locale, k)))
    assert cli.parser().parse_args(["--locale", "es"]).locale == "es"
