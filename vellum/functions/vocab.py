"""Closed vocabularies. Results depend on these exact entries."""

from __future__ import annotations

ENTITY_TYPES = ["TOPONYM", "PERSON", "ORGANIZATION", "COMMODITY"]
#: Fixed value: which type claims a text first when several found it.
CASCADE = ["TOPONYM", "COMMODITY", "PERSON", "ORGANIZATION"]

#: Function words that don't count as significant.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can
cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me might more most must my myself no nor not now of off on once only or other our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with would you your
yours yourself yourselves also though although however therefore thus hence yet still may shall ought need dare used say said
says saying one two three first second third another every much many
""".split()

#: Place spellings to the form that is looked up.
TOPONYM_SPELLINGS = {
    "mountserat": "Montserrat", "stkitts": "Saint Kitts", "st kitts": "Saint Kitts", "st. kitts": "Saint Kitts",
    "generalwi": "West Indies", "westindiesgeneral": "West Indies", "newengland": "New England", "new england": "New England",
    "barbadoes": "Barbados", "barbada": "Barbados", "barbudo": "Barbuda", "jamaico": "Jamaica", "summerset": "Somerset",
    "somersett": "Somerset", "bristoll": "Bristol", "londone": "London", "hispaniola": "Hispaniola",
    "st. christophers": "Saint Kitts", "saint christophers": "Saint Kitts", "st christophers": "Saint Kitts",
    "st. christopher": "Saint Kitts", "saint christopher": "Saint Kitts", "nevis island": "Nevis", "isle of nevis": "Nevis",
    "tobagoe": "Tobago", "tobago": "Tobago", "trinidad": "Trinidad", "trinidado": "Trinidad", "bermudas": "Bermuda",
    "bermudoes": "Bermuda", "carolina": "Province of Carolina", "virgina": "Virginia", "virginia": "Virginia",
    "guiana": "Guiana", "guyana": "Guiana", "surinam": "Suriname", "suriname": "Suriname", "martinico": "Martinique",
    "martinique": "Martinique", "guadalupe": "Guadeloupe", "guadaloupe": "Guadeloupe", "guadeloupe": "Guadeloupe",
    "curacao": "Curacao", "st. domingue": "Saint-Domingue", "saint domingue": "Saint-Domingue", "porto rico": "Puerto Rico",
    "puerto rico": "Puerto Rico", "havanna": "Havana", "havana": "Havana", "carthagena": "Cartagena",
}

#: Spellings of goods; distinct goods stay distinct.
COMMODITY_SPELLINGS = {
    "cocheneal": "Cochineal", "cockeneal": "Cochineal", "cocoa nutts": "Cocoa Nuts", "cocoa past": "Cocoa Paste",
    "cocoa paster": "Cocoa Paste", "cocoa vaste? waste? (60)": "Cocoa Waste", "cocoa past paste? (62)": "Cocoa Paste",
    "cocoa past? last?": "Cocoa Paste", "chocolate cast/past/last": "Chocolate Paste", "chocolate past": "Chocolate Paste",
    "cortex elatheria": "Cortex Elutheria", "cortex eletharia": "Cortex Elutheria", "cortex eletheria": "Cortex Elutheria",
    "elephants teeth": "Elephant Teeth", "elephant teeth": "Elephant Teeth", "fustick wood": "Fustic Wood",
    "wood, fustick": "Fustic Wood", "wood, fustick wood": "Fustic Wood", "wood, wood, fustick": "Fustic Wood",
    "gum arabeck": "Gum Arabic", "gum arabick": "Gum Arabic", "gum guiaci": "Gum Guaiacum", "gum guiacum": "Gum Guaiacum",
    "guiney grains": "Guinea Grains", "hopps": "Hops", "jallop?": "Jalap", "jollop": "Jalap", "lingum vitae": "Lignum Vitae",
    "muscavado sugar": "Muscovado Sugar", "orchal": "Orchil", "orchall?": "Orchil", "orchelia": "Orchil", "archelia": "Orchil",
    "sarsparila": "Sarsaparilla", "sasparilla": "Sarsaparilla", "tamerinds": "Tamarinds", "tortoise shells": "Tortoise Shell",
    "tortoise shell": "Tortoise Shell", "bay berries": "Bayberries", "bees wax": "Beeswax", "shruff": "Snuff",
    "shruff? snuff?": "Snuff", "snuff?": "Snuff", "vinellas": "Vanilla", "succand": "Succade", "succands": "Succade",
    "succads": "Succade", "barbados tarr": "Barbados Tar", "barbados turp": "Barbados Turpentine", "barbados t…": "Barbados Tar",
    "bermudos plat": "Bermuda Plait", "plat bermudos": "Bermuda Plait", "corrants? currants?": "Currants",
    "wppd, cocus": "Cocuswood", "wood, cocus": "Cocuswood", "soft raisans": "Soft Raisins", "slude": "Slude", "slude?": "Slude",
    "wood, boxwood": "Boxwood", "wood, braziletto": "Braziletto Wood", "wood, cam": "Camwood", "wood, camwood": "Camwood",
    "wood, cedar": "Cedarwood", "wood, cocoa": "Cocoa Wood", "wood, crocus": "Crocuswood", "wood, ebony": "Ebony",
    "wood, iron": "Ironwood", "wood, logwood": "Logwood", "wood, mahogany": "Mahogany", "wood, marble": "Marblewood",
    "wood, nicaragua": "Nicaragua Wood", "wood, pidgeonwood": "Pigeonwood", "wood, redwood": "Redwood",
    "wood, rosewood": "Rosewood", "wood, sweetwood": "Sweetwood", "train oyl": "Train Oil", "oyl turpyn": "Oil of Turpentine",
    "madera wine": "Madeira Wine", "salt petre": "Saltpetre", "hypococania": "Ipecacuanha", "sea horse teeth?": "Walrus Teeth",
}

#: Title prefixes in the order they are tried.
PERSON_TITLES = [
    ("mr.", "Mr"), ("mr ", "Mr"), ("master ", "Mr"), ("mrs.", "Mrs"), ("mrs ", "Mrs"), ("capt.", "Captain"), ("capt ", "Captain"),
    ("col.", "Colonel"), ("col ", "Colonel"), ("gen.", "General"), ("gen ", "General"), ("dr.", "Dr"), ("dr ", "Dr"),
    ("sir ", "Sir"), ("lord ", "Lord"), ("gov.", "Governor"), ("gov ", "Governor"),
]

#: Relations of the published ontology with their property codes.
STANDARD_RELATIONS = {
    "HAS_RESIDENCE": "P74", "HAS_MEMBER": "P107i", "HAS_LOCATION": "P53", "HAS_TYPE": "P2", "FALLS_WITHIN": "P89", "HAS_OWNER": "P52", "IDENTIFIED_BY": "P1",
}
#: The properties' names in the ontology's addresses.
_CRM = "http://www.cidoc-crm.org/cidoc-crm/"
STANDARD_URIS = {
    "HAS_RESIDENCE": _CRM + "P74_has_current_or_former_residence", "HAS_MEMBER": _CRM + "P107i_is_current_or_former_member_of",
    "HAS_LOCATION": _CRM + "P53_has_former_or_current_location", "HAS_TYPE": _CRM + "P2_has_type", "FALLS_WITHIN": _CRM + "P89_falls_within",
    "HAS_OWNER": _CRM + "P52_has_current_owner", "IDENTIFIED_BY": _CRM + "P1_is_identified_by",
}
#: Relations of the trade domain by field.
DOMAIN_RELATIONS = {
    "Trade": ["GROWN_IN", "PRODUCED_IN", "EXPORTED_FROM", "IMPORTED_TO", "SHIPPED_TO", "TRADED_IN", "TRADED_BY", "TRADED_WITH", "PRODUCED", "OPERATED_IN", "PARTNERED_WITH"],
    "Political": ["GOVERNED", "FOUNDED", "LED", "BASED_IN", "REGULATED", "CONTROLLED_BY"],
    "Life": ["BORN_IN", "DIED_IN"],
    "Movement": ["TRAVELED_TO"],
    "Labor": ["EMPLOYED_BY", "ENSLAVED_IN", "WORKED_IN"],
    "Social": ["ASSOCIATED_WITH", "FAMILY_OF", "MARRIED_TO"],
}
#: Ontology classes of the entity types.
CRM_CLASSES = {"TOPONYM": "E53_Place", "PERSON": "E21_Person", "ORGANIZATION": "E74_Group", "COMMODITY": "E55_Type"}
CRM_DEFAULT = "E1_CRM_Entity"

#: Abbreviations, plurals, and the characters folded or stripped when entity texts are compared.
ABBREVIATIONS = {"st.": "saint", "st": "saint"}
SINGULARS = {"slaves": "slave", "spices": "spice", "eggs": "egg", "grains": "grain", "wines": "wine", "cloths": "cloth", "timbers": "timber", "silks": "silk", "tobaccos": "tobacco"}
QUOTES = "‘’“”`\""
DASHES = "–—‐"
SURROUNDING = ".,;:!?¡¿\\[]{}()<>«»"
PUNCTUATION = ".,;:!?'\"-()[]{}@#$%^&*+=<>/\\|`~"
NUMBER_GROUP = r"[$£€]?\d+(?:[.,/\-:]\d+)*[%]?|[$£€]\d+"
