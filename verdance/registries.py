"""Fixed registries: units, bridges, geography fits, profiles."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Unit code | dimension | scale to the dimension's base unit | qualifiers | further aliases.
UNITS_TEXT = """
dimensionless | dimensionless | 1 |  | fraction,ratio,No dimension
percent | dimensionless | 0.01 |  | %,percent
mg | mass | 0.000001 |  | milligram,milligrams
g | mass | 0.001 |  | gram,grams
kg | mass | 1 |  | kilogram,kilograms
tonne | mass | 1000 |  | t,tonnes,metric_ton
kt | mass | 1000000 |  | kilotonne,kilotonnes
Gg | mass | 1000000 |  | gigagram,gigagrams
Mt | mass | 1000000000 |  | megatonne,megatonnes
short_ton | mass | 907.18474 |  |
lb | mass | 0.45359237 |  | pound,pounds
gCO2e | emission_mass | 0.001 | co2e | gCO2eq
kgCO2e | emission_mass | 1 | co2e | kgCO2eq
tCO2e | emission_mass | 1000 | co2e | tonneCO2e
gCO2 | emission_mass | 0.001 | co2 | g CO2
kgCO2 | emission_mass | 1 | co2 | kg CO2,Kg CO2
tCO2 | emission_mass | 1000 | co2 | t CO2,tonne CO2,Tonne CO2
gCH4 | emission_mass | 0.001 | ch4 | g CH4
kgCH4 | emission_mass | 1 | ch4 | kg CH4,Kg CH4
kgN2O | emission_mass | 1 | n2o | kg N2O,Kg N2O
kgN | emission_mass | 1 | nitrogen | kg N
gN | emission_mass | 0.001 | nitrogen | g N
kgN2O_N | emission_mass | 1 | n2o_n | kg N2O-N,Kg N2O-N
tC | emission_mass | 1000 | carbon | t C,tonne C,tonnes C
kgC | emission_mass | 1 | carbon | kg C
kgCF4 | emission_mass | 1 | cf4 | kg CF4
kgPFC | emission_mass | 1 | pfc | kg PFC
J | energy | 1 |  |
MJ | energy | 1000000 |  |
GJ | energy | 1000000000 |  |
TJ | energy | 1000000000000 |  |
Wh | energy | 3600 |  |
kWh | energy | 3600000 |  | KWh
MWh | energy | 3600000000 |  |
kWh_net_cv | energy | 3600000 | net_cv | kWh (Net CV)
kWh_gross_cv | energy | 3600000 | gross_cv | kWh (Gross CV)
MJ_net_cv | energy | 1000000 | net_cv |
GJ_net_cv | energy | 1000000000 | net_cv |
GJ_gross_cv | energy | 1000000000 | gross_cv |
ml | volume | 0.000001 |  |
l | volume | 0.001 |  | litre,litres,liter
m3 | volume | 1 |  | cubic metres,cubic meter
normal_m3 | volume | 1 | normal_conditions | m3 (n)
scf | volume | 0.028316846592 |  |
m | distance | 1 |  |
km | distance | 1000 |  | kilometer,kilometres
mile | distance | 1609.344 |  | miles
tonne.km | transport_work | 1000000 | freight | tonne-km,tkm
passenger.km | passenger_distance | 1000 | passenger | passenger-km,pkm
passenger | passenger_count | 1 | passenger | passengers
vehicle.km | vehicle_distance | 1000 | vehicle | vehicle-km
m2 | area | 1 |  | m²
ha | area | 10000 |  |
hour | time | 3600 |  | h,heure
day | time | 86400 |  |
year | time | 31557600 |  |
head | count | 1 | animal_head | animal
LTO | count | 1 | landing_takeoff_cycle |
start | count | 1 | engine_start |
mine | count | 1 | mine |
EUR | currency | 1 | EUR |
USD | currency | 1 | USD |
GBP | currency | 1 | GBP |
TRY | currency | 1 | TRY |
CAD | currency | 1 | CAD |
BRL | currency | 1 | BRL |
MXN | currency | 1 | MXN |
ZAR | currency | 1 | ZAR |
EGP | currency | 1 | EGP |
AED | currency | 1 | AED |
SAR | currency | 1 | SAR |
INR | currency | 1 | INR |
CNY | currency | 1 | CNY |
JPY | currency | 1 | JPY |
KRW | currency | 1 | KRW |
AUD | currency | 1 | AUD |
SGD | currency | 1 | SGD |
SEK | currency | 1 | SEK |
item | count | 1 | generic_item | unit,unité
room.night | service | 1 | room_night | Room per night
fte.hour | service | 1 | fte_hour | per FTE Working Hour
sheet.a4 | product | 1 | a4_sheet |
kg_product | product_mass | 1 | product |
tonne_product | product_mass | 1000 | product |
USD_2022_producer_price | currency | 1 | USD,2022,producer_price |
USD_2023_producer_price | currency | 1 | USD,2023,producer_price |
EUR_2019_ex_vat | currency | 1 | EUR,2019,ex_vat |
EUR_2020_ex_vat | currency | 1 | EUR,2020,ex_vat |
EUR_2021_ex_vat | currency | 1 | EUR,2021,ex_vat |
EUR_2022_ex_vat | currency | 1 | EUR,2022,ex_vat |
EUR_2023_ex_vat | currency | 1 | EUR,2023,ex_vat |
piece | count | 1 | piece |
device | count | 1 | device |
plant | count | 1 | plant |
meal | count | 1 | meal |
container | count | 1 | container |
book | count | 1 | book |
head.year | animal_time | 1 | animal_head_year | head/yr,head/year,animal/yr,animal/year
kg_fuel | product_mass | 1 | fuel | kg fuel
tonne_fuel | product_mass | 1000 | fuel | t fuel,tonne fuel,tonnes fuel
kg_dry_biomass | product_mass | 1 | dry_biomass | kg of dry biomass,kg dry matter combusted
tonne_aluminium | product_mass | 1000 | aluminium | tonne Al,Tonne Al
kg_refrigerant | product_mass | 1 | refrigerant |
person.month | person_time | 1 | person_month |
ha.year | area_time | 315576000000 | hectare_year |
TEU-km | container_distance | 1000 | teu |
m3.km | volume_distance | 1000 | volume_transport |
kg.km | transport_work | 1000 | freight | kg*km
toe_net_cv | energy | 41868000000 | net_cv |
toe_gross_cv | energy | 41868000000 | gross_cv |
kg_net_weight | product_mass | 1 | net_weight |
kg_nitrogen | product_mass | 1 | nitrogen |
kg_waste | product_mass | 1 | waste |
tonne_waste | product_mass | 1000 | waste |
kg_dry_matter | product_mass | 1 | dry_matter |
kg_live_weight | product_mass | 1 | live_weight |
kg_hydrogen | product_mass | 1 | hydrogen |
tonne_nitrogen | product_mass | 1000 | nitrogen |
tonne_p2o5 | product_mass | 1000 | p2o5 |
tonne_k2o | product_mass | 1000 | k2o |
tonne_clinker | product_mass | 1000 | clinker |
kg_active_substance | product_mass | 1 | active_substance |
kg_leather_treated | product_mass | 1 | leather_treated |
kg_nitrogen_applied | product_mass | 1 | nitrogen_applied |
kg_cod_removed | product_mass | 1 | cod_removed |
kg_tkn | product_mass | 1 | tkn |
kg_bio_cng | product_mass | 1 | bio_cng |
m2_shon | area | 1 | shon |
m2_wall | area | 1 | wall |
m2_floor | area | 1 | floor |
m2_roof | area | 1 | roof |
m_road | distance | 1 | road |
kg_hydrogen_per_100km | fuel_consumption_rate | 0.01 | hydrogen |
"""

# Dimensions that a dated parameter bridges: from, to, parameter.
BRIDGES = [
    ("volume", "mass", "density"),
    ("mass", "volume", "density"),
    ("volume", "energy", "calorific_value"),
    ("mass", "energy", "calorific_value"),
    ("distance", "transport_work", "load"),
    ("distance", "passenger_distance", "occupancy"),
    ("passenger_count", "passenger_distance", "distance"),
    ("currency", "currency", "exchange_rate"),
]

# Score of each geographic fit, in fallback order.
FIT_SCORES = {"country_specific": 100, "country_modelled": 90, "regional": 75, "continental": 65, "global": 50, "proxy": 35}

# Specificity of each geographic level.
SPECIFICITY = {"global": 0, "continent": 1, "region": 2, "country": 3, "state": 4, "province": 4, "city": 5, "grid": 6, "custom": 2}

# Profile, context, entity types, value kinds, uses, scopes, conditional conversion.
PROFILES = [
    ("corporate_carbon.ghg_protocol.scope1", "corporate_carbon", ["emission_factor", "implied_emission_factor"], ["co2e_total"], ["inventory"], ["scope 1"], True),
    ("corporate_carbon.ghg_protocol.scope2_location", "corporate_carbon", ["emission_factor", "implied_emission_factor"], ["co2e_total"], ["inventory"], ["scope 2"], False),
    ("corporate_carbon.ghg_protocol.scope3", "corporate_carbon", ["emission_factor", "implied_emission_factor"], ["co2e_total"], ["inventory"], ["scope 3"], True),
    ("lca.iso14040", "lca", ["lca_result", "characterization_result", "epd"], ["co2e_total", "characterization_factor"], ["characterization", "calculation_input"], [], False),
    ("pcf.iso14067", "pcf", ["lca_result", "characterization_result", "epd"], ["co2e_total", "characterization_factor"], ["characterization", "calculation_input"], [], False),
    ("cbam.eu_definitive", "cbam", ["embodied_emission_factor"], ["co2e_total"], ["calculation_input"], [], False),
    ("freight.glec", "freight", ["emission_factor", "implied_emission_factor"], ["co2e_total"], ["inventory"], [], True),
]

# Reasons after which a candidate isn't shown at all.
HARD_REASONS = [
    "entity_type_denied", "factor_kind_denied", "intended_use_denied", "scope_unknown", "scope_denied",
    "not_published", "quality_denied", "activity_concept_mismatch", "unit_incompatible", "unit_conditional_denied",
]

# 100-year warming potentials of CO2, CH4, N2O by assessment report.
GWP = {"AR4": (1, 25, 298), "AR5": (1, 28, 265)}

# Weights of the match score, in hundredths.
MATCH_WEIGHTS = {"activity": 30, "unit": 15, "geography": 20, "year": 10, "boundary": 10, "methodology": 5, "source_quality": 5, "data_quality": 5}


@dataclass(frozen=True)
class Unit:
    code: str
    dimension: str
    scale: Decimal
    qualifiers: tuple[str, ...]
    aliases: tuple[str, ...]


def units() -> list[Unit]:
    """The unit registry in its own order."""
    out = []
    for line in UNITS_TEXT.strip().splitlines():
        code, dimension, scale, qualifiers, aliases = ([p.strip() for p in line.split("|")] + ["", ""])[:5]
        out.append(Unit(code, dimension, Decimal(scale), tuple(q for q in qualifiers.split(",") if q), tuple(a.strip() for a in aliases.split(",") if a)))
    return out


# Activity families: code | concept | terms | terms of factors, where they differ | role | basis | scope | scope 3 categories | qualifiers that scope 3 requires.
FAMILIES_TEXT = """
gasoline | energy.gasoline | gasoline,motor gasoline,petrol,motor petrol,benzin,motor benzini,ottokraftstoff,essence,gasolina | motor gasoline,motor petrol | stationary_combustion | energy | scope_1 | 3 |
natural_gas | energy.natural_gas | natural gas,natural_gas,doğalgaz,doğal gaz,erdgas,gaz naturel | | stationary_combustion | energy | scope_1 | 3 |
diesel | energy.diesel | diesel,motorin,mazot,gas oil,gas_oil | diesel,motorin,mazot,distillate fuel oil no. 1,distillate fuel oil no. 2 | stationary_combustion | energy | scope_1 | 3 |
electricity | energy.electricity | electricity,electric,elektrik,grid electricity,grid_mix | | purchased_electricity | energy | scope_2 | 3 |
refrigerants | refrigerants | refrigerant,refrigerants,soğutucu,r134a,r410a,r32,hfc,hcfc | | fugitive_emissions | mass | scope_1 | |
road_freight | transport.freight.road | road freight,trucking,truck,hgv,kamyon,karayolu,tonne.km,ton-mile | | freight_transport | transport_work | scope_3 | 4,9 |
air_travel | transport.passenger.air | air travel,flight,aviation,uçuş,passenger flight,domestic flight | | business_travel | passenger_distance | scope_3 | 6 | haul
waste | waste | waste,disposal,landfill,recycling,atık,bertaraf,compost | | waste_treatment | mass | scope_3 | 5,12 | material,treatment
purchased_services | spend.services | service,services,education,training,consulting,hizmet,eğitim,spend,usd,eur,try | | purchased_service | spend | scope_3 | 1 |
"""

# Economic sectors of purchased services, and those that words of a query hint at.
SERVICE_SECTORS = ["51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "81", "92"]
SECTOR_HINTS = [("education", "61"), ("training", "61"), ("consulting", "5416"), ("legal", "5411"), ("accounting", "5412"), ("software", "51"), ("financial", "52"), ("insurance", "524")]

# Authority of a source, the smaller the better, in general and by country; sources of official figures.
AUTHORITY = {"ETKB": 0, "IPCC": 1, "GHG_PROTOCOL": 1, "DEFRA": 2, "EPA": 3, "EMBER": 3, "OPEN_CEDA": 4, "UNFCCC_TUIK": 5}
AUTHORITY_BY_COUNTRY = {
    "TR": {"ETKB": 0, "GHG_PROTOCOL": 1, "IPCC": 1, "EMBER": 2, "DEFRA": 8, "EPA": 8},
    "US": {"EPA": 0, "GHG_PROTOCOL": 1, "IPCC": 1, "DEFRA": 8, "ETKB": 8},
    "GB": {"DEFRA": 0, "GHG_PROTOCOL": 1, "IPCC": 1, "EPA": 8, "ETKB": 8},
    "CA": {"CANADA": 0, "GHG_PROTOCOL": 1, "IPCC": 1},
    "FR": {"ADEME": 0, "AIB": 1, "GHG_PROTOCOL": 2, "IPCC": 2},
    "DE": {"AIB": 0, "GHG_PROTOCOL": 1, "IPCC": 1},
    "NL": {"AIB": 0, "GHG_PROTOCOL": 1, "IPCC": 1},
    "SE": {"AIB": 0, "GHG_PROTOCOL": 1, "IPCC": 1},
}
OFFICIAL_SOURCES = ["ADEME", "AIB", "CANADA", "DEFRA", "EPA", "ETKB"]

# Fallback tiers in order, and whether one is a proxy.
TIERS = [("country_official", False), ("country_modelled", False), ("regional", False), ("global", False), ("foreign_proxy", True)]

# Weights of the search score, in hundredths.
SEARCH_WEIGHTS = {"semantic": 40, "context": 20, "geography": 20, "year": 10, "unit": 10}

# Mass numerators in kg; denominators of published components, their unit and how many of it they are.
MASS_TO_KG = {"mg": "0.000001", "g": "0.001", "kg": "1", "t": "1000", "tonne": "1000"}
COMPONENT_DENOMINATORS = [
    ("mj", "GJ", "0.001"), ("gj", "GJ", "1"), ("tj", "GJ", "1000"), ("kwh", "GJ", "0.0036"), ("mwh", "GJ", "3.6"), ("m3", "m3", "1"), ("m³", "m3", "1"),
    ("l", "m3", "0.001"), ("litre", "m3", "0.001"), ("liter", "m3", "0.001"), ("kg", "kg", "1"), ("t", "tonne", "1"), ("tonne", "tonne", "1"),
]

# Inventory units: unit | gas where the unit itself names it | multiplier to kg per the unit that follows | unit. 44/12 and 44/28 turn carbon and nitrogen to CO2 and N2O.
INVENTORY_UNITS = [
    ("t/tj", None, 1.0, "GJ"), ("kg/tj", None, 0.001, "GJ"), ("t c/tj", "CO2", 44 / 12, "GJ"), ("t/t", None, 1.0, "kg"), ("kg/t", None, 0.001, "kg"),
    ("kg ch4/head/yr", "CH4", 1.0, "head.year"), ("g/m2", None, 0.001, "m2"), ("kg/t dm", None, 0.001, "kg_dry_matter"), ("t/t waste", None, 1.0, "kg_waste"), ("kg/t waste", None, 0.001, "kg_waste"),
]
ACTIVITY_ALIASES = {"m^3": ("m3", 1), "m3": ("m3", 1), "ha": ("ha", 1), "t": ("kg", 1000), "head": ("head", 1)}

# French labels of units, their code, and whether they say more than the code.
FRENCH_UNITS = [
    ("tonne", "t", False), ("tonne de déchets", "t", True), ("litre", "L", False), ("kg de poids net", "kg", True), ("kg de poids vif", "kg", True),
    ("kWh PCI", "kWh", True), ("kWh PCS", "kWh", True), ("GJ PCI", "GJ", True), ("GJ PCS", "GJ", True),
]


@dataclass(frozen=True)
class Family:
    code: str
    concept: str
    terms: tuple[str, ...]
    factor_terms: tuple[str, ...]
    role: str
    basis: str
    scope: str
    categories: tuple[int, ...]
    required: tuple[str, ...]


def families() -> list[Family]:
    """The activity families in their own order."""
    out = []
    for line in FAMILIES_TEXT.strip().splitlines():
        code, concept, terms, own, role, basis, scope, categories, required = (p.strip() for p in line.split("|"))
        split = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
        out.append(Family(code, concept, split(terms), split(own) or split(terms), role, basis, scope, tuple(map(int, split(categories))), split(required)))
    return out
