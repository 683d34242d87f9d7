"""Rules for fire headlines as column expressions. A null title or text counts as empty; letters are lowered the Turkish way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import matching
from .text import WORD, C, _c, quote, turkish_lower

# Words, patterns and rule names of the headline rules.
STRONG = [
    "orman", "makilik", "maki alan", "makiye", "fundalık", "meşelik", "kızılçam", "zeytinlik", "anız", "örtü yangın", "açık alan yangın", "zirai alan", "mera alan", "milli park",
    "havadan ve karadan", "söndürme uçağı", "yangın söndürme helikopter", "söndürme helikopter", "ogm", "wildfire", "forest fire",
]
WEAK = ["otluk", "otlak", "tarla", "tarım arazi", "tarım alan", "hektar", "dönüm", "yanan alan", "arazöz", "sazlık", "kamışlık", "dağlık alan", "ağaçlık alan", "kırsal alan", "arazi yangın", "bahçelik", "yangın bölge"]
FIRE_WORD = "yang[ıi]n|alev|söndür|fire|blaze|giriş yasa"
BUILDING = (
    r"ev|evi|eve|evde|evdeki|evler|evleri|evlere|evinde|halı saha\S*|bungalov\S*|villa\S*|yazlık\S*|kulübe\S*|fabrika\S*|apartman\S*|daire\S*|bina\S*|otomobil\S*|araç\S*|aracı|tır|tır\S*|otobüs\S*|minibüs\S*|"
    r"kamyon\S*|tanker\S*|traktör\S*|motosiklet\S*|depo\S*|baraka\S*|ahır\S*|samanlık\S*|işyeri\S*|iş yeri\S*|market\S*|mağaza\S*|tesis\S*|atölye\S*|restoran\S*|otel\S*|okul\S*|hastane\S*|cami\S*|tekne\S*|"
    r"gemi\S*|uçak|jet|trafo\S*|baz istasyon\S*|plaza\S*|gecekondu\S*|konteyner\S*|çatı\S*"
)
SPREAD_TARGET = (
    "ormana|ormanlık alana|ormanlık bölgeye|makiliğe|makilik alana|zeytinliğe|zeytinlik alana|tarlaya|tarlalara|anıza|anızlara|otluk alana|otluğa|ağaçlık alana|araziye|çalılığa|çalılık alana|sazlığa|"
    "sazlık alana|fundalığa|meraya|bahçeye|bahçelere|ekili alana|ekinlere|bağlara|bağlık alana"
)
SPREAD_VERB = "(sıçra|yayıl|atla|ulaş)(dı|dığı|yan|an|mış|yarak|arak|yıp|ıp)"
BURNED = "orman yangın|örtü yangın|anız yangın|makilik yangın|zeytinlik yangın|arazi yangın|otluk yangın|tarla yangın|ekin yangın"
PREVENTED = r"(muhtemel|olası) (bir )?(orman|örtü|anız) yangın\S*|(orman|örtü|anız) yangın\S* (önüne geçil|önlen|engellen|riski|tehlikesi|ihtimali|çıkmasını önle)\S*"
NOT_A_SIGNAL = r"orman ürün\S*"
WEATHER = "hava durumu|termometre|meteoroloji|sıcaklık|derece"
NEIGHBOURS = {
    "Yunanistan": ["yunanistan", "yunan", "rodos", "sakız adası", "midilli", "girit", "semadirek", "limni", "atina", "selanik", "dedeağaç", "evros", "eğriboz", "mora"],
    "Bulgaristan": ["bulgaristan", "bulgar", "sofya", "burgaz", "filibe"],
    "Gürcistan": ["gürcistan", "gürcü", "tiflis", "batum", "acara"],
    "Suriye": ["suriye", "şam", "halep", "lazkiye", "idlib", "afrin", "rakka", "haseke", "kamışlı"],
    "Irak": ["irak", "bağdat", "musul", "erbil", "kerkük", "süleymaniye", "duhok"],
    "İran": ["iran", "tahran", "tebriz", "urmiye"],
    "Ermenistan": ["ermenistan", "erivan"],
    "Azerbaycan": ["azerbaycan", "bakü", "nahçıvan", "karabağ"],
    "Kıbrıs": ["kıbrıs", "kktc", "lefkoşa", "girne", "magosa", "gazimağusa", "baf", "limasol", "larnaka"],
}
FAR = [
    "avrupa", "ispanya", "portekiz", "fransa", "korsika", "italya", "sicilya", "sardinya", "almanya", "avusturya", "isviçre", "hollanda", "belçika", "ingiltere", "britanya", "iskoçya", "galler", "irlanda",
    "isveç", "norveç", "finlandiya", "danimarka", "polonya", "çekya", "çek cumhuriyeti", "slovakya", "macaristan", "romanya", "moldova", "ukrayna", "rusya", "sibirya", "yakutistan", "belarus", "litvanya",
    "letonya", "estonya", "hırvatistan", "bosna", "sırbistan", "karadağ", "arnavutluk", "makedonya", "kosova", "slovenya", "malta", "tenerife", "kanarya", "mallorca", "katalonya", "endülüs", "provence",
    "marsilya", "lizbon", "madrid", "roma",
    "abd", "amerika", "kaliforniya", "los angeles", "hawaii", "maui", "teksas", "florida", "alaska", "oregon", "nevada", "arizona", "kolorado", "washington", "new york", "kanada", "alberta", "quebec",
    "ontario", "british columbia", "meksika", "brezilya", "amazon", "şili", "arjantin", "bolivya", "paraguay", "uruguay", "peru", "kolombiya", "venezuela", "ekvador", "guatemala", "honduras",
    "avustralya", "yeni zelanda", "endonezya", "sumatra", "borneo", "kalimantan", "malezya", "filipinler", "tayland", "vietnam", "kamboçya", "japonya", "güney kore", "kuzey kore", "çin", "moğolistan",
    "hindistan", "nepal", "bangladeş", "pakistan", "afganistan", "kazakistan", "özbekistan", "türkmenistan", "kırgızistan", "tacikistan",
    "israil", "filistin", "gazze", "lübnan", "beyrut", "ürdün", "suudi arabistan", "yemen", "mısır", "libya", "tunus", "cezayir", "fas", "afrika", "güney afrika", "kongo", "kenya", "tanzanya", "etiyopya",
    "nijerya", "angola", "zambiya", "madagaskar",
]
PROVINCES = [
    "adana", "adıyaman", "afyonkarahisar", "afyon", "ağrı", "amasya", "ankara", "antalya", "artvin", "aydın", "balıkesir", "bilecik", "bingöl", "bitlis", "bolu", "burdur", "bursa", "çanakkale", "çankırı", "çorum",
    "denizli", "diyarbakır", "edirne", "elazığ", "erzincan", "erzurum", "eskişehir", "gaziantep", "giresun", "gümüşhane", "hakkari", "hakkâri", "hatay", "isparta", "mersin", "istanbul", "izmir", "kars",
    "kastamonu", "kayseri", "kırklareli", "kırşehir", "kocaeli", "konya", "kütahya", "malatya", "manisa", "kahramanmaraş", "mardin", "muğla", "muş", "nevşehir", "niğde", "ordu", "rize", "sakarya", "samsun",
    "siirt", "sinop", "sivas", "tekirdağ", "tokat", "trabzon", "tunceli", "şanlıurfa", "uşak", "van", "yozgat", "zonguldak", "aksaray", "bayburt", "karaman", "kırıkkale", "batman", "şırnak", "bartın", "ardahan",
    "iğdır", "yalova", "karabük", "kilis", "osmaniye", "düzce",
]
PROVINCE_NAMES = {"afyon": "afyonkarahisar", "hakkâri": "hakkari"}
HOME = ["türkiye", "türk", "ogm", "orman genel müdürlüğü"]
BORDER = "sınır"
NOT_A_PLACE = r"afrika sıca\S*|sibirya soğu\S*|balkan soğu\S*"
FROM_ENDING = "['’](dan|den|tan|ten)($|[^a-zçğıöşü])"
FOREIGN = "bulgaristan|yunanistan|italya|ispanya|portekiz|fransa|almanya|kaliforniya|amerika|abd|kanada|avustralya|rusya|ukrayna|suriye|irak|iran|israil|tunus|cezayir|l[iı]bya|f[ıi]rt[ıi]na\\s+abd"
FLAMES = "yang[ıi]n|ate[şs]"
VEGETATION = r"orman|otluk|an[ıi]z|makilik|[öo]rt[üu]\s+yang[ıi]n|çal[ıi]l[ıi]k|çam|a[ğg]a[çc]l[ıi]k|milli\s+park|zeytinlik|bu[ğg]day"
STRUCTURE = r"tekne|gemi|yat|trafo|fabrika|atölye|apartman|bina|daire|ev\s+yang[ıi]n|i[şs]\s+yeri|ara[çc]|otomobil|kamyon|otob[üu]s|[çc]iftli[ğg]i|ah[ıi]r|depo|market|hastane|okul|baca|konteyner"
NEGATIVE = [
    ("neg:kontrol-alinamadi", r"kontrol\s+alt[ıi]na\s+al[ıi]n(?:[ae]?m[aeıi])\w*", ["pos:kontrol-altina-alindi", "pos:kontrol-altinda"]),
    ("neg:kontrol-altinda-degil", r"kontrol\s+alt[ıi]nda\s+de[ğg]il", ["pos:kontrol-altina-alindi", "pos:kontrol-altinda"]),
    ("neg:sondurulemedi", r"s[öo]nd[üu]r[üu]l(?:[ae]?m[aeıi])\w*", ["pos:sondurulu", "pos:tamamen-sonduruldu"]),
    ("neg:sondurme-cabasi", r"s[öo]nd[üu]r(?:[üu]lmeye|meye|me)\s+(?:[çc]al[ıi][şs]|[çc]aba|faaliyet|[çc]al[ıi][şs]malar)\w*", ["pos:sondurulu", "pos:tamamen-sonduruldu"]),
    ("neg:sondurulurken", r"s[öo]nd[üu]r[üu]l[üu]rken", ["pos:sondurulu", "pos:tamamen-sonduruldu"]),
]
POSITIVE = [
    ("pos:tamamen-sonduruldu", r"tamamen\s+s[öo]nd[üu]r[üu]ld[üu]", "extinguished"),
    ("pos:sondurulu", r"s[öo]nd[üu]r[üu]l(?:d[üu]|m[üu][şs]t[üu]r|m[üu][şs])(?![a-zçğıöşü])", "extinguished"),
    ("pos:kontrol-altina-alindi", r"kontrol\s+alt[ıi]na\s+al[ıi]n(?:d[ıi]|arak|an|m[ıi][şs])", "contained"),
    ("pos:kontrol-altinda", r"kontrol\s+alt[ıi]nda(?!\s+de[ğg]il)", "contained"),
    ("pos:sogutma", r"so[ğg]utma\s+(?:[çc]al[ıi][şs]malar|faaliyet|i[şs]lem)\w*", "contained"),
    ("pos:mudahale-suruyor", r"m[üu]dahale\s+(?:ediliyor|ediyor|s[üu]r[üu]yor|devam\s+ediyor|[çc]al[ıi][şs]malar[ıi]\s+s[üu]r)", "ongoing"),
    ("pos:devam-ediyor", r"yang[ıi]n[a-zçğıöşü]*\s+(?:[a-zçğıöşü0-9']+\s+){0,3}?devam\s+ediyor", "ongoing"),
    ("pos:yayiliyor", r"(?:yay[ıi]l[ıi]yor|yay[ıi]lmaya\s+devam|s[ıi][çc]rad[ıi]|b[üu]y[üu]yor)", "ongoing"),
]
STATES = ["extinguished", "contained", "ongoing"]
KINDS = {
    "blocked": "cinayet|kaza yaptı|maç|seçim|bakan.*istifa",
    "recovery": "ağaçlandır|fidan dik|fidan dağıt|fidanlar? toprakla|hatıra orman|yeniden yeşer|orman.*rehabilitasyon|yanan alan",
    "preparation": "yangın (tatbikat|eğitim|sezon|önlem|hazırlı)|orman yangın.*(tatbikat|eğitim|önlem|hazırlı)|yangın gözetleme|yangın kule|arazöz.*(teslim|eğitim)|orman.*(tatbikat)",
    "field": "anız|otluk|tarla|ot yangın|ekili alan|tarım alan|örtü yangın|çöplük|bahçe yangın",
    "fire": "yangın|alev",
    "nature": "yaban hayat|yaban keçi|milli park|tabiat park|doğa koruma|orman köylü|orman haftası|orman kahraman",
    "forester": "ormancı",
    "forester_topic": "ağaçlandır|fidan|dikim|restorasyon|rehabilitasyon|yenileme|yeşer|erozyon|iklim|proje|orman varlığ",
}
STAGES = [("restoration", "ağaçlandır|fidan dikim|fidan dik|restorasyon|yeniden yeşer"), ("out", "söndürüldü"), ("controlled", "kontrol altına alındı|kontrol altında"), ("started", "çıktı|çıkan|başladı|müdahale")]
CASED_NAME = "([A-ZÇĞİÖŞÜ][a-zçğıöşü]+)['’]"

#: Patterns made from the lists; they use nothing that only one regex dialect knows.
BUILDING_IN_TITLE = rf"""(^|[\s'’"(])({BUILDING})($|[\s,.!?:;'’"):])"""
VEGETATION_BURNED = f"{BURNED}|(^|[^{WORD}])(hektar|dönüm)|({SPREAD_TARGET}) {SPREAD_VERB}"


def begins(words: Sequence[str]) -> str:
    """Pattern: one of the words with no letter or digit before it."""
    return f"(^|[^{WORD}])({'|'.join(map(quote, words))})"


def whole(words: Sequence[str]) -> str:
    """Pattern: one of the words with no letter or digit on either side."""
    return f"{begins(words)}($|[^{WORD}])"


NEAR = whole([w for words in NEIGHBOURS.values() for w in words])
REACHES_HOME = f"{whole(HOME + PROVINCES)}|(^|[^{WORD}]){BORDER}($|[^ls])"


def _low(x: C) -> Column:
    return turkish_lower(F.coalesce(_c(x), F.lit("")))


def _joined(title: C, body: C) -> Column:
    return F.concat(_low(title), F.lit(" "), _low(body))


def _kept(found: Sequence[Column]) -> Column:
    return F.filter(F.array(*found), lambda w: w.isNotNull())


def wildfire_basis(title: C, body: C) -> Column:
    """strong or weak for a vegetation fire; else why not: weather_forecast, no_fire_word, building_or_vehicle_title, no_signal."""
    t, x = _low(title), F.regexp_replace(_joined(title, body), NOT_A_SIGNAL, " ")
    fire, building = x.rlike(FIRE_WORD), t.rlike(BUILDING_IN_TITLE)
    spared = building & ~F.regexp_replace(x, PREVENTED, " ").rlike(VEGETATION_BURNED)
    strong = F.when(~fire, "no_fire_word").when(spared, "building_or_vehicle_title").otherwise("strong")
    weak = F.when(building, "building_or_vehicle_title").when(~fire, "no_fire_word").otherwise("weak")
    return F.when(t.rlike(WEATHER) & ~t.rlike(FIRE_WORD), "weather_forecast").when(x.rlike(begins(STRONG)), strong).when(x.rlike(begins(WEAK)), weak).otherwise("no_signal")


def geography(title: C, body: C) -> Column:
    """Struct of turkey, basis and the places that decided: far ones, or neighbours followed by what reaches home."""
    known = [*FAR, *(w for words in NEIGHBOURS.values() for w in words), *HOME, *PROVINCES]

    def told(met: Column, border: Column) -> Column:
        far_names = F.array_intersect(F.array(*map(F.lit, FAR)), met)
        near_names = _kept([F.when(F.arrays_overlap(F.array(*map(F.lit, words)), met), F.lit(country)) for country, words in NEIGHBOURS.items()])
        home_names = F.concat(F.array_intersect(F.array(*map(F.lit, HOME + PROVINCES)), met), F.when(border, F.array(F.lit(BORDER))).otherwise(F.array().cast("array<string>")))
        return F.struct(far_names.alias("far"), near_names.alias("near"), home_names.alias("home"))

    def decided(names: Column) -> Column:
        far, near, home = (F.size(names[c]) > 0 for c in ("far", "near", "home"))
        basis = F.when(far, "far_country").when(~near, "no_foreign_place").when(home, "neighbour_reaching_turkey").otherwise("neighbour_only")
        matched = F.when(far, names["far"]).when(near, F.concat(names["near"], names["home"])).otherwise(F.array().cast("array<string>"))
        return F.struct((~far & (~near | home)).alias("turkey"), basis.alias("basis"), matched.alias("matched"))

    found = lambda x: matching.let(matching.whole_words(x, known), lambda met: told(met, x.rlike(f"(^|[^{WORD}]){BORDER}($|[^ls])")))
    return matching.let(matching.let(F.regexp_replace(_joined(title, body), NOT_A_PLACE, " "), found), decided)


def province_in_title(title: C) -> Column:
    """The one province that a title names, with a capital; null for none or several. A name first met as 'from there' doesn't count."""
    t = _low(title)
    words, after = matching.followed(t, 5)
    met = F.filter(F.array_intersect(F.array(*map(F.lit, PROVINCES)), words), lambda w: ~F.element_at(after, F.array_position(words, w).cast("int")).rlike(FROM_ENDING))
    same = F.create_map(*(F.lit(x) for pair in PROVINCE_NAMES.items() for x in pair))
    names = F.array_distinct(F.transform(met, lambda w: F.coalesce(same[w], w)))
    first = F.element_at(names, 1)
    capital = F.when(first.startswith("i"), "İ").when(first.startswith("ı"), "I").otherwise(F.upper(F.substring(first, 1, 1)))
    return F.when(F.size(names) == 1, F.concat(capital, F.substring(first, 2, 40)))


def named_places(x: C, names: Sequence[str]) -> Column:
    """The names that occur with no letter or digit before them, in the list's order; endings may follow."""
    lowered = [n.replace("İ", "i").lower() for n in names]
    met = matching.at_starts(_low(x), lowered)
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(met, turkish_lower(n)))


def about_province(title: C, body: C, province: C, names: Sequence[str]) -> Column:
    """Whether a strong wildfire story names this province and no other."""
    found = named_places(_joined(title, body), names)
    return (wildfire_basis(title, body) == "strong") & (F.size(found) == 1) & F.coalesce(F.element_at(found, 1) == _c(province), F.lit(False))


def relevance(x: C) -> Column:
    """vegetation_fire, or the first reason against it."""
    low = _low(x)
    return (
        F.when(~low.rlike(FLAMES), "no_fire_word").when(low.rlike(FOREIGN), "foreign_country").when(low.rlike(VEGETATION), "vegetation_fire")
        .when(low.rlike(STRUCTURE), "structure_or_vehicle_fire").otherwise("no_vegetation_context")
    )


def status_claim(x: C) -> Column:
    """Struct of state, rule, phrase and suppressed rules; null where the text claims nothing.

    A negation makes the state ongoing, whatever else is said; without one the strongest state wins, the earlier rule within a state.
    """
    low = _low(x)
    negated = F.lit(False)
    for _, p, _ in NEGATIVE:
        negated = negated | low.rlike(p)

    def vetoed(rule: str) -> Column:
        out = F.lit(False)
        for _, p, targets in NEGATIVE:
            if rule in targets:
                out = out | low.rlike(p)
        return out

    claim = lambda rule, p, state: F.when(low.rlike(p), F.struct(F.lit(state).alias("state"), F.lit(rule).alias("rule"), F.regexp_extract(low, p, 0).alias("phrase")))
    of_state = {s: [claim(r, p, s) for r, p, its in POSITIVE if its == s] for s in STATES}
    negatives = [claim(r, p, "ongoing") for r, p, _ in NEGATIVE]
    found = F.when(negated, F.coalesce(*of_state["ongoing"], *negatives)).otherwise(F.coalesce(*(c for s in STATES for c in of_state[s])))
    lost = [F.when(low.rlike(p) & vetoed(r), F.lit(f"{r} (vetoed)")) for r, p, _ in POSITIVE]
    stronger = sorted((rule for rule in POSITIVE if rule[2] != "ongoing"), key=lambda rule: STATES.index(rule[2]))
    beaten = F.coalesce(*(F.when(low.rlike(p) & ~vetoed(r), F.lit(f"{r} (contradicted)")) for r, p, _ in stronger))
    suppressed = _kept([*lost, F.when(negated, beaten)])
    return F.when(found.isNotNull(), F.struct(found["state"].alias("state"), found["rule"].alias("rule"), found["phrase"].alias("phrase"), suppressed.alias("suppressed")))


def kind(title: C) -> Column:
    """recovery, preparation, field, fire or nature; null for none of them."""
    t = _low(title)
    of = lambda k: t.rlike(KINDS[k])
    nature = of("nature") | (of("forester") & of("forester_topic"))
    return (
        F.when(of("blocked"), None).when(of("recovery"), "recovery").when(of("preparation"), "preparation")
        .when(of("field") & of("fire") & ~t.contains("orman yangın"), "field").when(t.contains("orman") & of("fire"), "fire").when(nature, "nature").when(of("fire"), "fire")
    )


def green(title: C) -> Column:
    """Whether a title tells of recovery, preparation or nature and is about Turkey."""
    return F.coalesce(kind(title).isin("recovery", "preparation", "nature"), F.lit(False)) & geography(title, title)["turkey"]


def stage(title: C) -> Column:
    """What a title says happened, the latest stage first; null for nothing."""
    t = _low(title)
    return F.coalesce(*(F.when(t.rlike(p), F.lit(name)) for name, p in STAGES))


def places_in_title(title: C, province: C) -> Column:
    """Names with a case ending, lowered, each once, without the province."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(title), F.lit("")), F.lit(CASED_NAME), F.lit(1)), turkish_lower)
    return F.array_distinct(F.filter(found, lambda p: p != _low(province)))


def claim_outcome(reason: C, claimed: C, cities: C, open_incidents: C, age_hours: C, lookahead_hours: float) -> Column:
    """Where a story stops: irrelevant, no_claim, no_city, multiple_cities, deferred, no_incident, matched or multiple_incidents.

    A story without an open incident waits until the time in which one may still be seen has passed. Unknown counts are zero.
    """
    n, cities = F.coalesce(_c(open_incidents), F.lit(0)), F.coalesce(F.size(_c(cities)), F.lit(0))
    return (
        F.when(~F.coalesce(_c(reason) == "vegetation_fire", F.lit(False)), "irrelevant").when(~F.coalesce(_c(claimed), F.lit(False)), "no_claim").when(cities < 1, "no_city").when(cities > 1, "multiple_cities")
        .when((n == 0) & (_c(age_hours) < lookahead_hours), "deferred").when(n == 0, "no_incident").when(n == 1, "matched").otherwise("multiple_incidents")
    )
