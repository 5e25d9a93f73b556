"""The models that are fitted to the per-diet table, as data."""

from __future__ import annotations

from tallyframe.operators.models import Model, crossed

_SLOPE = "dens_slopes"
_SINGLE = [
    "mass_range", "sum_R", "LocalRichness", "RERichness", "FreqBirds", "RaptorRichness", "numb_prey_spp",
    "NE_intake", "numb_prey", "largest_prey_mass", "smallest_prey_mass", "PreyPerPellet", "ShannEnt_rare",
    "DietRichness_rare",
]

# Responses and terms of the linear models.
OLS = [
    Model("l_ns", ("l_re",)),
    Model("l_ns", ("log_LocalRichness",)),
    Model(_SLOPE, ("ecozone",)),
    *[Model(_SLOPE, (x,)) for x in _SINGLE],
    Model(_SLOPE, ("sum_R", "NE_intake", "numb_prey_spp")),
    Model(_SLOPE, crossed("sum_R", "numb_prey_spp")),
    Model(_SLOPE, ("sum_R", "numb_prey_spp")),
    Model(_SLOPE, ("sum_R", "NE_intake", "numb_prey_spp", "RERichness")),
    Model(_SLOPE, ("NE_intake", "numb_prey_spp", "RERichness", "RaptorRichness")),
    Model(_SLOPE, ("NE_intake", "numb_prey_spp", "RERichness", "RaptorRichness", "FreqBirds")),
    Model(_SLOPE, ("ShannEnt_rare", "DietRichness_rare")),
    Model(_SLOPE, ("ShannEnt_rare", "DietRichness_rare", "PreyPerPellet", "mass_range")),
    Model(_SLOPE, crossed("ShannEnt_rare", "mass_of_most_common_dropones")),
    Model(_SLOPE, crossed("DietRichness_rare", "ShannEnt_rare")),
    *[Model(y, ("DietRichness_rare", "PreyPerPellet", "largest_prey_mass"))
      for y in (_SLOPE, "ShannEnt_rare", "mass_range")],
    Model("sum_R", ("numb_prey_spp",)),
    Model("sum_R", ("NE_intake",)),
    Model("sum_R", ("RERichness",)),
    Model("NE_intake", ("RERichness",)),
    Model("NE_intake", ("numb_prey_spp", "RERichness", "RaptorRichness", "FreqBirds")),
    Model("NE_intake", ("RERichness", "RaptorRichness", "FreqBirds")),
    Model("NE_intake", ("RERichness", "FreqBirds")),
    Model("NE_intake", ("FreqBirds",)),
    *[Model("baow_a", (x,)) for x in (
        "numb_prey_spp", "RERichness", "mass_range", "largest_prey_mass", "smallest_prey_mass")],
    Model("baow_a", crossed("RERichness", "numb_prey_spp")),
    Model("mass_range", ("largest_prey_mass",)),
    Model("PreyPerPellet", ("DietRichness_rare",)),
    Model("ShannEnt_rare", ("PreyPerPellet", "DietRichness_rare")),
    Model("ShannEnt_rare", ("mass_of_most_common_dropones",)),
    Model("smallest_prey_mass", ("PreyPerPellet", "numb_prey")),
    Model("largest_prey_mass", ("PreyPerPellet",)),
]



def near_copies(model: Model) -> bool:
    """Does the model hold two of the columns (or of their logarithms) that nearly copy each other?

    sum_R grows with the number of prey types and baow_a is its reciprocal.  In
    the star-schema data they are copies to seven digits, so coefficients of
    such models have no stable digits to compare; r2 has.
    """
    used = {model.response, *(n for t in model.terms for n in ((t,) if isinstance(t, str) else t))}
    return len({n.removeprefix("log_") for n in used} & {"sum_R", "numb_prey_spp", "baow_a"}) > 1


# Responses and terms of the Poisson models.
POISSON = [
    ("NumPos", ["numb_prey_spp", "NE_intake", "sum_R", "FreqBirds", "RERichness"]),
    ("NumPos", ["numb_prey_spp", "FreqBirds", "RERichness"]),
    ("NumPos", ["numb_prey_spp"]),
    ("NumPos", ["RERichness"]),
    ("NumPos", ["FreqBirds"]),
]

_THREE = ("numb_prey_spp", "RERichness", "RaptorRichness")
_PAIRS = (("numb_prey_spp", "RERichness"), ("numb_prey_spp", "RaptorRichness"), ("RERichness", "RaptorRichness"))

# Responses, terms and groups of the models with a random intercept.
MIXED = [
    *[Model(_SLOPE, (x,), "ecozone") for x in (
        "numb_prey_spp", "sum_R", "NE_intake", "RERichness", "FreqBirds", "RaptorRichness")],
    Model(_SLOPE, ("sum_R", "numb_prey_spp"), "ecozone"),
    Model(_SLOPE, ("sum_R", "numb_prey_spp", "RERichness"), "ecozone"),
    Model(_SLOPE, ("FreqBirds", "RaptorRichness", "sum_R", "numb_prey_spp"), "ecozone"),
    Model(_SLOPE, ("sum_R", "numb_prey_spp", "RERichness", "RaptorRichness"), "ecozone"),
    Model(_SLOPE, ("sum_R", "numb_prey_spp", "RERichness", "RaptorRichness", "FreqBirds"), "ecozone"),
    Model("sum_R", ("numb_prey_spp",), "ecozone"),
    Model(_SLOPE, _THREE, "ecozone"),
    Model(_SLOPE, (*_THREE, "FreqBirds"), "ecozone"),
    Model(_SLOPE, crossed(*_THREE), "ecozone"),
    Model(_SLOPE, (*_THREE, *_PAIRS), "ecozone"),
    Model(_SLOPE, (*_THREE, *_PAIRS[1:]), "ecozone"),
    Model(_SLOPE, (*_THREE, _PAIRS[2]), "ecozone"),
    Model(_SLOPE, ("RERichness", "RaptorRichness", _PAIRS[2]), "ecozone"),
    Model(_SLOPE, (), "Continent"),
    Model("NumPos", ("log_sum_R", "log_numb_prey_spp", "log_NE_intake", "FreqBirds", "RERichness"), "ecozone"),
]

# Models of the rarefied metrics with an intercept per biome.
BIOME = [*[Model("rare_NT", (x,), "Biome") for x in ("Mass", "FairProp")], *[Model("rare_SE", (x, "rare_NT"), "Biome") for x in ("Mass", "FairProp")]]
