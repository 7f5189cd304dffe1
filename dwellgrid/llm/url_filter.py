"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm.common import LOWER, UPPER

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
N_GRAMS = (3, 4)
FEATURES = 1 << 14

# Labelled hosts for training, by family and from general knowledge; no host of the sample tables is among them.
UNWANTED_HOSTS = {
    "gambling": """
        casino-royal free-casino best-casino-bonus casinos-online casino-club online-slots slot-machines poker-bets
        sports-bets bets-today live-betting bet-now jackpot-win win-big lottery-win roulette-wheel bookmaker-odds poker poker-stars
        online-poker casino casino24 slots slots-club vegas-bets royal-bets bet365-odds betting betting-odds jackpots
        jackpot-casino blackjack-live bingo-cash""",
    "pharmacy": """
        buy-pills diet-pills pills-online pill-shop cheap-meds cheap-viagra pharmacy-cheap generic-cialis
        no-prescription-meds weight-loss-pills steroids-online buy-xanax viagra viagra-now
        online-viagra meds meds-online canada-meds rx-meds pharmacy-rx online-pharmacy pills pills-shop super-pills
        xanax-pills hair-loss-pills cialis-now""",
    "link spam": """
        link-farm seo-farm spam-links spam-mail article-spam backlinks-cheap buy-backlinks farm-links seo-links
        bulk-traffic free-traffic spam-blog spam spammers mail-spam
        link-exchange-farm links-seo link-building-cheap seo-backlinks content-farm click-farm""",
    "adult": """
        xxx-videos adult-cams adult-movies adult-dating adult-chat porn-tube free-porn sex-cams sex-chat hot-escorts
        x-rated nude-pics erotic-stories hentai-x milf-videos adult adult-tube adult-pics adults-only-x xxx xxx-tube
        hot-xxx porn porno porn-movies best-porn sex sex-videos live-sex sexy-girls sexy-chat hot-girls nude-cams x-cams""",
    "advertising": """
        ad-server ads-server adserve ads-network ad-click ads-banner banner-ads popup-ads adsystem ads-media web-ads
        ad-exchange clicks-affiliate adservice ads ads-online ads24 adsense-clicks adtech-media doubleads
        banners-exchange popunder-ads""",
    "tracking": """
        tracker user-tracker track-user click-track tracking-pixel web-tracking pixel-track trackers-net beacon-stats
        metrics-track visitor-tracking telemetry-pixel track track-clicks track-pixel tracker-js
        tracking tracking-stats ip-tracker""",
    "money": """
        payday-loans cheap-loans fast-loans loans-now earn-money-fast easy-cash quick-cash get-rich-quick
        debt-relief-now crypto-doubler loans-fast cheap-payday payday-advance instant-cash instant-payday money-fast
        cash-now quick-loans loan-shark-cash""",
    "piracy": """
        free-download-crack warez-free crack-serial keygen-download torrent-movies pirated-games free-movies-stream
        nulled-scripts warez crack-keygen torrents torrent-tube cracked-games serials-crack
        torrent-download""",
    "counterfeit": """
        replica-watches fake-watches replica-handbags cheap-replica fake-designer fake-diplomas outlet-cheap
        knockoff-shoes replica-bags rolex-replica rolex-fake fakes-shop replicas""",
}
ORDINARY_HOSTS = """
    garden history weather library news university recipes museum science travel health music city-council book-club
    open-data school-board train-times bird-watch bike-repair art-school education nation national-park tradition
    fiction-books nutrition station-cafe collection action-network information translations theatre thesis theory
    therapist mother-care father-time brother-hood another-day gathering other-voices leather-works northern-lights
    southern-cooking earth-watch health-service maths-help strength-training thoughts fourth-estate sunshine-coast
    ocean-shore shipping-news fresh-bread british-history english-grammar spanish-lessons publishing-house wishing-well
    table-tennis cable-car vegetables stable-yard double-bass reliable-tools hand-made island-ferry wonderland
    understanding house-plans houses-museum restaurant-guide rest-home forest-walks west-end chess-league press-office
    business-school glass-blowing winter-sports river-trust engineering finance-ministry insurance-advice letters
    travelling hearing-aids sharing-economy river-crossing morning-paper evening-post ring-road springs
    reading-room road-map broadcast headlines threads-and-yarn roads-agency adventure advice-centre administration
    academy-of-music railway-track athletics-track track-and-field soundtrack adulthood-studies adult-education
    better-homes alphabet-songs tibet-travel pillow-shop caterpillar-park essex-council sussex-news middlesex
    farm-shop dairy-farm farmers-market wind-farm market-town cashmere-wool freedom-press freelance-writers
    free-university download-centre windows-help winery-tours window-cleaning twin-towns linked-data hyperlinks-history
    cheaper-energy money-museum credit-union student-loans cash-flow-lessons media-studies server-room click-chemistry
    pixel-art photo-club video-archive movie-reviews film-festival stream-ecology watch-makers lottery-fund
    pharmacy-school prescription-charges dating-of-rocks hotel-guide stories-for-children exercise-classes
    x-ray-physics linux-help index-of-names taxes-explained hand-bags-repair shoes-museum bonus-track-reviews
    architecture ballet-company ceramics dentistry electricity-board fishing-boats gymnastics horticulture
    ice-skating jazz-records kitchen-recipes landscape-painting meteorology natural-gas observatory pottery
    quilting-patterns rowing-club sailing-school town-planning umbrella-repair violin-makers walking-holidays
    xylophone-lessons youth-hostel zoology community-centre county-records primary-school veterinary-surgeon
    citizens-advice crafts-fair corner-shop cheese-makers spoon-carving literacy-project counting-house
    transport-museum package-design racket-sports contact-lenses practice-nurse bedroom-furniture freezer-repair
    betrothal-customs alphabetical-lists spanner-sets spaniel-club pilgrim-routes pillars-of-rome cashier-training
    medieval-fairs medals-of-honour masters-degrees cambridge-lectures shadows-in-art heads-and-tails roads-to-rome
    accountancy acoustics agriculture airport algebra almanac ambulance anthropology antiques apple-orchard aquarium
    archaeology archery athletics atlas autumn-leaves backpacking badminton balcony-plants banking-history barley
    baroque basketry bathroom-tiles battlefield bees bell-ringers berries bicycle biography biscuits blacksmith
    blankets blossom boating bookbinding border-collies botanic-garden boulders bowling brass-band brewing bricklaying
    broadband budget-report building-society bus-timetable butterflies cabinet-makers calendar calligraphy camping
    candles canoe carpentry cartoons castle-keep casual-wear category-theory cattle caves cello census cereals charity
    chemistry chestnut children chimney cinema-history circus-skills civic-trust classics climate clocks clothing
    coastal-path coffee coins comedy committee computing concert conservation consumer-rights copper cottage cricket
    crochet cucumbers culture customs cyclists dancing daffodils deer delivery-service design diary dictionary dinosaurs
    disability-rights district-nurse diving dolphins drawing driving-lessons drums ducks early-years ecology economics
    editors elections elephants embassy employment encyclopaedia environment equality essays estate evaluation
    exhibition experience exploration fabric falconry families fashion ferns fiddle figures firewood fishmonger flags
    flour flute folklore football forestry fountain foxes frogs fruit fungi galaxies gallery genealogy geology germany
    gloves goats gold-leaf government graphics grassland greenhouse guitar habitat hamlet handball harp harvest heritage
    hiking hockey holidays honey horses housing humanities icebergs illustration immigration industry insects interiors
    investment irrigation jigsaws journalism judges jungle justice kites laboratory lakes lambs language lanterns
    laundry lavender learning legends lessons lichens lifeboat linguistics literature livestock lobsters logistics
    maritime marshland masonry mathematics meadows mechanics memorial methods microscopes military minerals ministry
    monastery monuments mosaics mosses motorway mushrooms mythology navigation neighbours netball newspapers nursing
    oceans offices olives onions optics orchards otters owls oxygen palace parades pastry patents pathology peacocks
    pedagogy pension petition physics piano pilots plumbing politics ponies population porcelain portraits potatoes
    powder-snow preservation printing prisons probability pronunciation property psychology publishers pumpkin puzzles
    radio rainfall ramblers reference refugees regatta religion renaissance reptiles research reservoir residents
    resorts retirement rhetoric rhythm roses rhubarb safari sandstone satellite scouts sculpture sea-shells seasons
    secretary seeds seminar sessions sewing shepherds shrubs singers sketches skiing society sociology soil solar
    soldiers songbirds spectrum spelling spiders sponsors squirrels stables stamps statistics steam-trains sculptors
    stitching strawberries students suburbs surveyors sustainable swans symphony tailors teachers technology telescope
    temple textiles tides timber tomatoes toys tractors trade-unions trains treasure triangles tulips tunnels turbines
    typography unions vaccines valley vegetarian vehicles vineyard volcano volunteers voters wardrobe waterfalls weaving
    weddings whales wildlife wolves woodland workshops writers yachts
    adult-learners adults-in-care adulthood sextant sextons sexton-books essex-farms poppies popular-science popcorn
    corner-stones cornwall portal-tombs portugal sports-day bonsai tracks racetracks trackways tracing-family
    linked-rings linking-roads blinkers farmland farm-animals seoul spandrels spanish spaghetti spare-parts replication
    replies cashmere cashews casement castles casket-makers cast-iron slotted-screws slots-in-wood better-bread alphabets
    sorbet abbeys jacks pokers-and-tongs polka poker-work medal medicine remedies pillars pillows caterpillars
    pillion loaned-paintings money-box honey-money free-range freedom freeze freehold stream-life downloads
    crackle-glaze cracked-bells nutcrackers keystone serials serial-killers-of-aphids wares warehouses softwares
    torrential-rain fakirs faked-antiques-guide outlets handbook watches watch-repair meadows-and-roads shadows-theatre
    leads heads loads-and-beams road-works salads ballads nomads adventurers adders address admiral advent banners
    clicking-beetles pixels beacons-walks metrics statues museum-visitor videos camera cameo camshaft chatterbox
    windfall winding-roads winners windmill-trust luck-folklore wheelwright
    theology the-times thirteen-colonies the-hague thistle-society tion-ridge thames-barrier think-tank third-age
"""
_SHAPES = (
    "https://{}.example.com/en/12.html", "http://www.{}.example.org/fr/7", "https://m.{}.example.net/de/3/",
    "http://blog.{}.com/es/44", "https://{}.org/en/9?page=2", "http://www.{}.net/",
    "https://{}.example.org/de/61.html", "http://{}.example.com/fr/25/", "https://www.{}.info/en/5#top",
    "http://m.{}.example.com/es/80", "https://blog.{}.example.net/en/17",
)


def addresses(hosts: list[str], each: int, shapes=_SHAPES) -> list[str]:
    """``each`` addresses per host.  Both classes take all shapes in turn, so scheme, domain and path tell little."""
    n = len(shapes)
    return [shapes[(i + k * n // each) % n].format(host) for i, host in enumerate(hosts) for k in range(each)]


# Labelled addresses for training: unwanted ones (1) and ordinary ones (0).  Each unwanted host stands there as often as
# brings the classes to about the same size.
UNWANTED = addresses(" ".join(UNWANTED_HOSTS.values()).split(), 3)
ORDINARY = addresses(ORDINARY_HOSTS.split(), 1)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null.  Rules are a short list: one test each, longest first."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def n_grams(host: Column, path: Column, sizes=N_GRAMS) -> Column:
    """Character n-grams of the framed host and path, marked by part; time and memory follow the address's length."""

    def grams(mark: str, text: Column, n: int) -> Column:
        chars = F.split(F.concat(F.lit("<"), text, F.lit(">")), "")
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")))

    return F.concat(*[grams(mark, part, n) for n in sizes for mark, part in (("h", host), ("p", path))])


def labelled_urls(spark: SparkSession, unwanted=UNWANTED, ordinary=ORDINARY) -> DataFrame:
    """The small table ``url, label`` (1 unwanted, 0 ordinary)."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(1.0).alias("label")) for u in unwanted]
    rows += [F.struct(F.lit(u).alias("url"), F.lit(0.0).alias("label")) for u in ordinary]
    return spark.range(1).select(F.inline(F.array(*rows)))


def hashed(urls: DataFrame, features: int = FEATURES) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) and the column ``features``."""
    with_grams = urls.withColumn("grams", n_grams(F.col("host"), F.col("path")))
    hashing = HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features")
    return hashing.transform(with_grams).drop("grams")


def train(labelled: DataFrame, features: int = FEATURES) -> LogisticRegressionModel:
    """Fit on a small labelled table (``url, label``); rows without a label are left out."""
    host, path = url_parts(F.col("url"))
    rows = labelled.where(F.col("label").isNotNull()).select(host.alias("host"), path.alias("path"), "label")
    fit = LogisticRegression(maxIter=100, regParam=0.01, standardization=False)
    return fit.fit(hashed(rows.coalesce(1), features))


def judged(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, probability``.

    The verdict is the rule's where one fits, else ``block`` if the model's probability reaches one half.  Pages are
    scored in place: no shuffle, no Python, only the address column is read.

    Defined cases: a null address or one without ``://`` has empty host and path, fits no rule and is judged by the model
    on these empty parts.  Null and repeated ids pass through, row for row.  No rows give no rows.
    """
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    scored = model.transform(hashed(parts, model.numFeatures))
    named = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for rule in rules for x in rule]) if rules else None
    ruled = by_rule[F.col("rule")] if rules else F.lit(None).cast("string")
    verdict = F.coalesce(ruled, F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return named.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
