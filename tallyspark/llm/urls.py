"""URL filter: listed rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained in numpy on the driver from LABELLED, a small table of labelled URLs that is
written down here. Its weights are one vector of BUCKETS floats, which bounds the broadcast.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
judged by the model like any other (an empty string has no n-grams and scores the bias, which allows).
Repeated rows are judged alike. Columns of other names pass through; outputs replace equal names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

BUCKETS = 1 << 15
PRIME = np.uint64(0x9E3779B97F4A7C15)
SIZES = (3, 4, 5)

# The labelled URL table (hosts and paths that are advertising, spam, gambling, malware
# or adult sites; and ordinary ones). Its names are invented; none is taken from a table that is judged.
BLOCKED = """
casino-palace.test/slots grandcasino.test/bonus royal-casinos.test/en/14 casinoplay.test/jackpot casinos-online.test/roulette mobile-casino.test/de/8
mega-bets.test/odds bets-live.test/fr/6 sportbets.test/play bestbets.test/tips bet-online.test/es/21 bet-now.test/en/44 superbet.test/de/7 betting-tips.test/odds poker-room.test/en/2 pokerstack.test/play
diet-pills.test/order pills-express.test/en/3 rx-pills.test/buy sleep-pills-shop.test/de/40 cheap-meds.test/discount cheap-watches.test/replica cheapviagra.test/buy viagra-online.test/en/5 cheap-loans.test/apply
spam-mails.test/a spambox.test/en/77 spam-server.test/de/12 spampage.test/fr/8 mail-spam.test/list seo-spam.test/links link-farms.test/links linkfarm.test/fr/2 clickfarm.test/en/9 content-farm.test/seo
ads-network.test/banner ads-tracker.test/en/8 ads-server.test/es/5 popup-ads.test/click adserve.test/pixel clickads.test/track banner-ads.test/en/33 track-clicks.test/pixel tracking-pixel.test/track
adult-videos.test/xxx adult-films.test/en/19 adultcams.test/live adult-chat.test/en/1 sexy-adult.test/de/3 xxx-tube.test/video xcams.test/cam-x porn-hd.test/xxx dating-adult.test/fr/7
malware-files.test/exe phish-login.test/verify crack-keygen.test/crack warez-files.test/get torrent-warez.test/en/4 virus-scan-alert.test/exe
free-money.test/now free-iphone.test/win free-coins.test/en/6 win-prizes.test/win lotto-win.test/es/12 win-now.test/bonus payday-cash.test/cash crypto-doubler.test/win
"""
ALLOWED = """
blog.garden.test/en/12 www.history.test/de/77 news.paper.test/fr/5 m.weather.test/es/3.html library.city.test/en/400/
www.theatre.test/en/671?page=2 blog.nation.test/en/369 m.thunder.test/en/25 bleeding-heart-flowers.test/fr/825 www.stations.test/es/533
www.university.test/research/paper.html docs.snake.test/library/os.html wiki.science.test/wiki/Physics museum.art.test/exhibits
mathematics.test/en/1 otherland.test/de/612 brother.test/es/797 blog.mention.test/en/853 www.orient.test/fr/414 m.herald.test/en/785.html
recipes.kitchen.test/soup school.teacher.test/lesson/4 travel.guide.test/rome maps.street.test/de/9 health.clinic.test/advice
blog.ingram.test/en/9 www.stone.test/en/99 m.edison.test/de/2/ handmade.test/es/44 reason.test/en/500.html www.ouest.test/fr/88
parliament.gov.test/bills court.law.test/cases/81 weather.sky.test/today music.choir.test/en/7 sport.league.test/results/2
www.linguist.test/en/62 blog.wharf.test/fr/65.html eastern.test/de/210 thistle.test/es/874 nested.test/en/977 mobile.phone.test/en/3
bakers-street.test/en/21 spare-parts.test/shop better-homes.test/de/3 kettle.test/es/6 cookery.test/fr/11 lessons-in-art.test/en/90 walking-tours.test/play pillars-of-stone.test/en/2
track-and-field.test/results adds-and-sums.test/en/14 cash-crops.test/farms wintergarden.test/de/7 online-library.test/live liveryard.test/buy chess-openings.test/bonus-chapter beehive.test/order
castle-ruins.test/en/9 spamalot-review.test/fr/4 cassette-deck.test/es/61 clickety-clack-trains.test/en/15 linked-data.test/links farmers-market.test/discount virtual-museum.test/click meadow.test/video
villagehall.test/en/6 seaside.test/de/52 lighthouse.test/fr/23 orchard.test/es/18 harbour.test/en/34 timetable.test/de/81 poetry.test/en/45 geology.test/fr/70 painter.test/es/29 carpenter.test/en/62
singer.test/de/14 archive.test/en/1 football-club.test/fr/38 runners.test/es/55 chemistry.test/en/87 planets.test/de/26 bicycle.test/en/50 dentist.test/fr/17 bookshop.test/buy hardware-store.test/shop
alphabet.test/en/8 winter-sports.test/de/31 window-frames.test/fr/12 roads-and-rails.test/en/5 farming.test/es/9 adulthood-studies.test/en/70 between.test/fr/3 fresh-air.test/en/41
"""
#: All digits look alike to the model.
DIGITS = str.maketrans("123456789", "000000000")
#: (host, path, verdict): a rule fits its host and all subdomains when the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the hosts (but for their last labels) and of the paths, each kept apart: rows and buckets, once for each row, rows ascending."""
    found = []
    for mark, texts in ((1, [h.rpartition(".")[0] or h for h in hosts]), (2, paths)):
        texts = [f"^{t.lower().translate(DIGITS)}$" if t else "" for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters of the text from here on
        for n in SIZES:
            at = np.flatnonzero(left >= n)
            code = np.full(len(at), mark * 8 + n, dtype=np.uint64)
            for j in range(n):
                code = (code ^ points[at + j]) * PRIME
                code ^= code >> np.uint64(29)
            found.append(row[at] * BUCKETS + (code >> np.uint64(20)).astype(np.int64) % BUCKETS)
    once = np.unique(np.concatenate(found))
    return once // BUCKETS, once % BUCKETS


def train(blocked: str = BLOCKED, allowed: str = ALLOWED, epochs: int = 25, rate: float = 0.5, bias: float = -1.0) -> tuple[np.ndarray, float]:
    """Weights from the labelled table by AdaGrad on the log loss, rows in one fixed order; bias is a fixed prior.

    Each labelled URL also stands under the usual subdomains and beside a neutral second-level name.
    """
    hosts, paths, labels = [], [], []
    for urls, label in ((blocked, 1.0), (allowed, 0.0)):
        for url in urls.split():
            host, slash, rest = url.partition("/")
            name = host.removesuffix(".test")
            own = sorted({host} | {f"{sub}{name.removeprefix('www.').removeprefix('blog.').removeprefix('m.')}.example.test" for sub in ("", "www.", "m.", "blog.")})
            hosts, paths, labels = hosts + own, paths + [(slash + rest).partition("?")[0]] * len(own), labels + [label] * len(own)
    at, buckets = features(hosts, paths)
    rows = [(x, label) for x, label in zip(np.split(buckets, np.searchsorted(at, np.arange(1, len(hosts)))), labels, strict=True)]
    weight = {label: 0.5 * len(rows) / sum(y == label for _, y in rows) for label in (0.0, 1.0)}
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            found, label = rows[i]
            size = np.sqrt(len(found))
            slope = (1 / (1 + np.exp(-(weights[found].sum() / size + bias))) - label) * weight[label] / size
            squares[found] += slope * slope
            weights[found] -= rate * slope / np.sqrt(squares[found])
    return weights.astype(np.float32), bias


def scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probabilities that the URLs are to be blocked; n-grams that training never met weigh nothing."""
    rows, buckets = features(hosts, paths)
    met = weights[buckets]
    total = np.bincount(rows, weights=met, minlength=len(hosts))
    size = np.maximum(1, np.bincount(rows, minlength=len(hosts)))
    return 1 / (1 + np.exp(-(total / np.sqrt(size) + bias)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    at = F.position(F.lit("://"), known)
    rest = F.when(at > 0, known.substr(at + 3, F.length(known))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, rules=RULES, model: tuple[np.ndarray, float] | None = None, limit: float = 0.5) -> DataFrame:
    """df (with a column url) and host, path, rule, block_score and verdict."""
    weights, bias = model or train()
    shared = df.sparkSession.sparkContext.broadcast((weights, bias))

    @pandas_udf("double")
    def block_score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w, b = shared.value
        return pd.Series(scores(w, b, hosts.tolist(), paths.tolist()), dtype="float64")

    host, path = host_and_path(F.col("url"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    named = df.withColumns({"host": host, "path": path})
    scored = named.withColumns({"rule": rule, "block_score": block_score("host", "path")})
    by_model = F.when(F.col("block_score") >= limit, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(said, by_model))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged: page_id, host, path, rule, verdict, block_score."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
