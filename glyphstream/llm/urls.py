"""URL filters: rules on host and path, and for all other urls host word segmentation with naive Bayes.

A host's labels, less the public suffix and common prefixes, are split at every sign that is not a letter; each run of letters is cut
into words by a unigram Viterbi search, in which an unknown word of n letters has a probability that falls with n. The words of
host and path are scored by multinomial naive Bayes, trained on the labelled table below: a word counts as often as it occurs.

Rules: the host is what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; the path follows up to ``?`` or ``#``. A
rule fits its host and all subdomains if the url's path begins with the rule's; the longest fitting rule wins.

Cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and has no words, so that it is allowed;
an empty host likewise; hosts and paths of any length are read in whole; repeated rows get equal verdicts; an empty table gives an
empty result; other columns are kept out. A host's segmentation is made once per batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: common words with rough frequencies per million
UNIGRAMS = {}
for _frequency, _words in (
    (
        3000,
        """
the of and to in is for on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has
search free but our one other do no information time they site he up may what which their news out use any there see only so his when contact here
business who web also now help get view online first been would how were services some these click its like service than find price date back top
people had list name just over state year day into email two health world next used go work last most products music buy data make them should product
system post her city add policy number such please available copyright support message after best software then good video well where info rights
public books high school
        """,
    ),
    (
        1000,
        """
through each links she review years order very privacy book items company read group need many user said does set under general research university
mail full map reviews program life know games way days management part could great united hotel real item international center must store travel
comments made development report off member details line terms before hotels did send right type because local those using results office education
national car design take posted internet address community within states area want phone shipping reserved subject between forum family long based
code show even black check special prices website index being women much sign file link open today technology south case project same pages version
section own found sports house related security both county american photo game members power while care network down computer systems three total
place end following download him without per access think north resources current posts big media law control water history pictures size art personal
since including guide shop directory board location change white text small rating rate government children during return students shopping account
times sites level digital profile previous form events love old john main call hours image department title description insurance another why shall
property class still money quality every listing content country private little visit save tools low reply customer december compare movies include
college value article york man card jobs provide food source author different press learn sale around print course job canada process teen room stock
training too credit point
        """,
    ),
    (
        400,
        """
join science men categories advanced west sales look english left team estate box conditions select windows photos gay thread week category note live
large gallery table register however june october november market library really action start series model features air industry plan human provided
required second accessories cost movie forums march september better say questions july yahoo going medical test friend come server study application
cart staff articles feedback again play looking issues april never users complete street topic comment financial things working against standard tax
person below mobile less got blog party payment equipment login student let programs offers legal above recent park stores side act problem red give
memory performance social august quote language story sell options experience rates create key body young america important field few east paper
single age activities club example girls additional password latest something road gift question changes night hard texas oct pay four poker status
browse issue range building seller court february always result audio light write war offer blue groups easy given files event release analysis
request china making picture needs possible might professional yet month major star areas future space committee hand sun cards problems london
washington meeting become interest child keep enter california share similar garden schools million added reference companies listed baby learning
energy run delivery net popular term film stories put computers journal reports try welcome central images president notice original head radio until
cell color self council away includes track australia discussion archive once others entertainment agreement format least society months log safety
friends sure trade edition cars messages marketing tell further updated association able having provides david fun already green studies close common
drive specific several gold living sep collection called short arts lot ask display limited powered solutions means director daily beach past natural
whether due electronics five upon period planning database says official weather mar land average done technical window france pro region island
record direct microsoft conference environment records district calendar costs style url front statement update parts ever downloads early miles sound
resource present applications either ago document word works material bill written talk federal hosting rules final adult tickets thing centre
requirements via cheap kids finance true minutes else mark third rock gifts europe reading topics bad individual tips plus auto cover usually edit
together videos percent fast function fact unit getting global tech meet far economic player projects lyrics often subscribe submit germany amount
watch included feel though bank risk thanks everything deals various words production commercial james weight town heart advertising received choose
treatment newsletter archives points knowledge magazine error camera girl currently construction toys registered clear golf receive domain methods
chapter makes protection policies loan wide beauty manager india position taken sort models michael known half cases step engineering florida simple
quick none wireless license paul friday lake whole annual published later basic sony shows corporate google church method purchase customers active
response practice hardware figure materials fire holiday chat enough designed along among death
        """,
    ),
):
    UNIGRAMS |= dict.fromkeys(_words.split(), _frequency)

#: words that mark unwanted hosts, as unigrams too
_BAD = "casino poker bets bet betting gamble gambling slots jackpot roulette pills pharmacy viagra cialis meds drugs cheap discount deals replica adult xxx porn sex sexy nude cams escort milf hot dating spam farm seo backlinks clicks click ads ad adserver track tracker tracking tracks popup banner affiliate promo win winner prize lottery free bonus loans payday credit cash crypto bitcoin invest forex torrent warez crack keygen serial download malware phishing login verify hack".split()
UNIGRAMS |= {w: 300 for w in _BAD if w not in UNIGRAMS}

#: the labelled table: host (and path) by class
BLOCKED = """
discountpharmacy buyviagra viagra-online viagrasale viagrapharmacy cheapviagra onlinemeds cheapcialis bestpills rxpills pillstore pharmacydeals genericmeds medsdirect diet-pills
sportsbets bettingbonus bet-now livebets bettingtips betking onlinebetting bettingodds bigbets sportsbetting
casinoroyal onlinecasino slotsjackpot pokerbonus jackpotwinner luckyslots livecasino royalcasino casinogames pokerstars vegasslots slotmachines
megajackpot roulettebonus blackjackcasino playpoker pokeronline casinobets freespins winbig win-cash instantwin winmoney
adultcams xxxvideos freexxx xxxtube sexdating hotgirls porntube nudecams freeporn pornvideos sexchat livesex camgirls adultvideos adultdating
adultfree milfdating escortservice sexyescorts hotmilf nudegirls adultfriend
linkfarm spamlinks seofarm backlinks buybacklinks contentfarm clickfarm spammers spamblast bulkspam spammail farmlinks seolinks cheapbacklinks
adserver tracking clicktrack trackads popupads ads-network adclick bannerads adnetwork adtracker trackpixel pixeltrack usertrack
adtracking affiliateclicks affiliatebonus clickbanner popuptraffic adpopup adsdelivery adtraffic
paydayloans cheaploans fastcash quickloans easycredit badcredit freeprize winprize lotterywin lottowinner freecrypto bitcoinbonus
forexbonus bitcoindouble cryptoinvest makemoneyfast freemoney getrich cashbonus freebonus freegift giftcards freeiphone
crackkeygen warezdownload torrentcrack serialkeygen malwaredownload phishinglogin verifyaccount loginverify securelogin hackaccount
replicawatches cheapreplica cheapmeds cheapjerseys cheapbags fakewatches discountreplica cheapdeals hotdeals
""".split()
ALLOWED = """
dailynews worldnews citynews localnews weathermap sciencejournal universitylibrary publiclibrary schoolbooks historymuseum cooking recipes
travelguide hotelguide gardenclub musicstore bookstore bookreview moviereview sportsnews footballclub healthcare hospital medicalresearch
softwaresupport computerhelp opensource webdesign photogallery artmuseum cityoffice governmentservices statepolicy lawoffice insurancecompany
bankofamerica carservice autoparts realestate homeandgarden familyhistory childrensbooks englishcourse languageschool technews engineering
energyreport environment oceanresearch spacecenter chemistry biology mathematics philosophy theater concerttickets filmfestival
forum community members wiki docs support about contact products shop order freelibrary freecourse cheapflights winterguide trackandfield farmhouse familyfarm
download downloads softwaredownload freesoftware freedownload login account secure webmail mail calendar status api cdn static images media
video videos photos music games gaming play playground kids school teacher student campus college research institute academy
news press journal magazine times post herald tribune gazette chronicle review reviews blogs weather traffic maps transport trains buses
airport flights hotels holiday vacation camping hiking cycling running tennis golf soccer baseball basketball swimming fitness yoga
doctor dentist clinic nursing mentalhealth nutrition foodandwine kitchen bakery coffee restaurant farmersmarket organicfarm greenfarm
bank savings mortgage taxes accounting finance economy business jobs careers hiring market exchange investorrelations charity foundation
law court police fire government parliament city county council park museum gallery library archive heritage church
developers code git data cloud hosting server network security privacy linux python java database statistics analytics
house home garden furniture tools hardware paint lighting cleaning repair auto cars bikes trucks boats
fashion shoes clothing jewelry watches watchmaker beauty hair wedding baby toys pets dogs cats horses birds
friends familytree genealogy stories poems novels authors writers readers publisher print design art theatre dance opera jazz
directwin winterwonderland windows windmill window trackrecord racetrack soundtrack freedom freelance freeway adulteducation
""".split()
_LETTERS = re.compile(r"[^\W\d_]+")
_SKIPPED = frozenset("www m blog com net org example http https html htm php index page".split())
LONGEST = max(map(len, UNIGRAMS))
_TOTAL = float(sum(UNIGRAMS.values()))
_KNOWN = {w: math.log(f / _TOTAL) for w, f in UNIGRAMS.items()}
_UNKNOWN = [0.0, *(math.log(10.0 / (_TOTAL * 10.0**n)) for n in range(1, LONGEST + 1))]


def segment(name: str) -> list[str]:
    """The likeliest cut of a run of letters into unigrams; unknown words of up to LONGEST letters are allowed, at a price."""
    best, back = [0.0], [0]
    for j in range(1, len(name) + 1):
        score, at = -math.inf, j - 1
        for i in range(max(0, j - LONGEST), j):
            s = best[i] + _KNOWN.get(name[i:j], _UNKNOWN[j - i])
            if s > score:
                score, at = s, i
        best.append(score)
        back.append(at)
    words, j = [], len(name)
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def words_of(text: str) -> list[str]:
    """Segmented words of a host or path, less those that say nothing."""
    return [w for run in _LETTERS.findall(text.lower()) if run not in _SKIPPED for w in segment(run)]


@lru_cache(maxsize=1)
def model() -> tuple[float, dict[str, float]]:
    """(log prior odds, log likelihood ratio of each word of the labelled table) of the class to block."""
    bad, good = Counter(w for h in BLOCKED for w in words_of(h)), Counter(w for h in ALLOWED for w in words_of(h))
    vocabulary = bad.keys() | good.keys()
    n1, n0 = sum(bad.values()) + len(vocabulary), sum(good.values()) + len(vocabulary)
    return math.log(0.3 / 0.7), {w: math.log((bad[w] + 1) / n1) - math.log((good[w] + 1) / n0) for w in vocabulary}


def odds(text: str) -> float:
    """Log likelihood ratio of a host's or path's words; unseen words say nothing."""
    ratios = model()[1]
    return sum(ratios.get(w, 0.0) for w in words_of(text))


def log_odds(host: Column, path: Column) -> Column:
    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        seen: dict[str, float] = {}
        prior = model()[0]

        def of(text: str) -> float:
            if text not in seen:
                seen[text] = odds(text)
            return seen[text]

        return pd.Series([prior + of(h) + (odds(p) if len(p) > 1 else 0.0) if h else prior for h, p in zip(hosts, paths)], dtype=float)

    return score(host, path)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the score of the method, for every row."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    p = p.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("log_odds", log_odds(F.col("host"), F.col("path")))
    return p.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
