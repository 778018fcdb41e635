"""Words by locale: names, places, streets, with how common they are.

A locale is a language, or a language and a region (de, de-AT). What a locale doesn't have comes from the next one in its
chain: the region's own, the language's, English. All lists are this library's own choice; the later in a list, the
rarer, by the weights below; English is drawn evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rng

DEFAULT = "en"
#: What the n-th word of a list counts beside the first one: one over the square root of its place.
FALL = 0.5

#: By locale and kind. Kinds: first_f, first_m, last, street (a whole name of one), word, place (city, state, first digits of the
#: postal code, number of digits it has in all), county, phone (the beginning of numbers that nobody has).
CORPORA: dict[str, dict[str, list]] = {
    "de": {
        "first_f": ["Anna", "Marie", "Sophie", "Lena", "Emma", "Katharina", "Julia", "Greta", "Ingrid", "Heike", "Ursula", "Renate"],
        "first_m": ["Lukas", "Jonas", "Paul", "Felix", "Stefan", "Thomas", "Matthias", "Jürgen", "Karl", "Uwe", "Dieter", "Götz"],
        "last": ["Müller", "Schmidt", "Schneider", "Weber", "Wagner", "Hoffmann", "Schäfer", "Koch", "Bauer", "Krüger", "Voigt", "Brandt", "Seidel", "Pohl"],
        "street": ["Hauptstraße", "Bahnhofstraße", "Gartenweg", "Lindenallee", "Schulstraße", "Mühlenweg", "Am Markt", "Kirchplatz"],
        "place": [("Berlin", "Berlin", "10", 5), ("Hamburg", "Hamburg", "20", 5), ("München", "Bayern", "80", 5), ("Köln", "Nordrhein-Westfalen", "50", 5), ("Leipzig", "Sachsen", "04", 5), ("Freiburg", "Baden-Württemberg", "79", 5), ("Rostock", "Mecklenburg-Vorpommern", "18", 5)],
        "word": ["Abend", "Brücke", "Garten", "Himmel", "Kupfer", "Laterne", "Morgen", "Nebel", "Quelle", "Sommer", "Wasser", "Winter"],
        "county": ["Landkreis Nordfeld", "Landkreis Südwald", "Landkreis Oberau"],
        "phone": ["+49-30-23125"],
    },
    "de-AT": {
        "place": [("Wien", "Wien", "1", 4), ("Graz", "Steiermark", "8", 4), ("Linz", "Oberösterreich", "4", 4), ("Salzburg", "Salzburg", "5", 4), ("Innsbruck", "Tirol", "6", 4)],
        "phone": ["+43-1-58858"],
    },
    "es": {
        "first_f": ["María", "Carmen", "Lucía", "Ana", "Isabel", "Laura", "Pilar", "Elena", "Rocío", "Inés"],
        "first_m": ["Antonio", "José", "Manuel", "David", "Javier", "Miguel", "Álvaro", "Sergio", "Iñaki", "Raúl"],
        "last": ["García", "Fernández", "González", "Rodríguez", "López", "Martínez", "Sánchez", "Pérez", "Gómez", "Núñez", "Ibáñez", "Peña"],
        "street": ["Calle Mayor", "Calle Real", "Avenida del Mar", "Plaza de la Fuente", "Calle del Olmo", "Paseo del Río"],
        "place": [("Madrid", "Madrid", "28", 5), ("Barcelona", "Cataluña", "08", 5), ("Valencia", "Comunidad Valenciana", "46", 5), ("Sevilla", "Andalucía", "41", 5), ("Bilbao", "País Vasco", "48", 5)],
        "word": ["agua", "camino", "fuente", "invierno", "luna", "mañana", "noche", "otoño", "piedra", "río", "tierra", "viento"],
        "county": ["Comarca del Norte", "Comarca del Llano"],
        "phone": ["+34-900-000"],
    },
    "fr": {
        "first_f": ["Marie", "Camille", "Léa", "Chloé", "Manon", "Juliette", "Hélène", "Nathalie", "Sylvie", "Aurélie"],
        "first_m": ["Jean", "Pierre", "Louis", "Hugo", "Antoine", "Nicolas", "François", "Benoît", "Étienne", "Jérôme"],
        "last": ["Martin", "Bernard", "Dubois", "Thomas", "Robert", "Petit", "Durand", "Leroy", "Moreau", "Lefèvre", "Garnier", "Chevalier"],
        "street": ["rue de la Gare", "rue du Moulin", "avenue des Tilleuls", "place de l'Église", "rue des Écoles", "chemin du Lac"],
        "place": [("Paris", "Île-de-France", "75", 5), ("Lyon", "Auvergne-Rhône-Alpes", "69", 5), ("Nantes", "Pays de la Loire", "44", 5), ("Lille", "Hauts-de-France", "59", 5), ("Rennes", "Bretagne", "35", 5)],
        "word": ["arbre", "brume", "étoile", "fleuve", "hiver", "jardin", "lumière", "matin", "nuage", "ombre", "pierre", "soleil"],
        "county": ["canton du Nord", "canton du Val"],
        "phone": ["+33-1-99-00"],
    },
}


def known(locale: str) -> str:
    """The locale as it is written here; an error for one whose language is unknown."""
    from ..errors import ConfigInvalid
    from .names import suggest

    parts = locale.replace("_", "-").split("-")
    name = "-".join([parts[0].lower(), *(p.upper() for p in parts[1:2])])
    if parts[0].lower() not in {DEFAULT, *(x.split("-")[0] for x in CORPORA)}:
        near = suggest(parts[0].lower(), [DEFAULT, *CORPORA], 1)
        raise ConfigInvalid(f"no locale '{locale}'", hints=(f"did you mean '{near}'?" if near else f"there are {', '.join(sorted({DEFAULT, *CORPORA}))}",))
    return name


def chain(locale: str) -> list[str]:
    """Where a locale's words are looked for, in this order."""
    name = known(locale)
    return list(dict.fromkeys([name, name.split("-")[0], DEFAULT]))


def entries(locale: str, kind: str) -> list | None:
    """A kind's words in the first locale of the chain that has them; None where only English does."""
    return next((CORPORA[x][kind] for x in chain(locale) if kind in CORPORA.get(x, {})), None)


def weights(n: int) -> list[float]:
    return [(k + 1) ** -FALL for k in range(n)]


def drawn(u: Column, values: list) -> Column:
    """A value, the earlier in the list the likelier."""
    return rng.weighted(u, values, weights(len(values)))


def table(spark: SparkSession, locales: list[str] | None = None) -> DataFrame:
    """locale, kind, place, value, weight: the corpora as a table, each locale with what its chain gives it."""
    rows = []
    for locale in locales or sorted(CORPORA):
        for kind in sorted({k for x in CORPORA.values() for k in x}):
            found = entries(locale, kind) or []
            rows += [(known(locale), kind, i, v if isinstance(v, str) else v[0], w) for i, (v, w) in enumerate(zip(found, weights(len(found)), strict=True))]
    return spark.createDataFrame(rows, "locale string, kind string, place int, value string, weight double")


def ascii_folded(c: Column) -> Column:
    """Letters without marks, as addresses need them."""
    pairs = {"äáàâ": "a", "öóô": "o", "üúù": "u", "éèêë": "e", "íîï": "i", "ñ": "n", "ç": "c"}
    plain = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.translate(plain, "".join(pairs), "".join(v * len(k) for k, v in pairs.items())), "[^a-z0-9.]", "")
