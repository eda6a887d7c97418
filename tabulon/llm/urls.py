"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Scoring is one DataFrame expression: n-grams of host and path are hashed into a bounded weight array, a literal in the
plan. The model is trained on a small labelled table of URLs, whose features come from the same expression.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import lower_ascii, table

#: Rules of the registered query: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Width of the hashed feature space and the n-gram lengths.
BUCKETS, GRAMS = 16384, (3, 4)

#: The labelled table, as site names and paths. Blocked: pills, gambling, adult, spam, fake and pirate sites.
BLOCKED_SITES = """pills-outlet buy-viagra generic-cialis rx-pills-shop no-prescription-meds diet-pills-24 herbal-pills casino-royal
online-casino mega-casino slots-jackpot poker-bonus bet-win-big sports-betting roulette-vip free-spins adult-club adult-videos-hd
xxx-tube sex-cams hot-adult-chat porn-free nude-pics escort-city live-sex-girls milf-cams spam-center bulk-spam link-farms
backlink-farm click-farm traffic-spam seo-spam-network free-money-fast payday-loans quick-loan-now crypto-doubler bitcoin-profit
get-rich-now work-from-home-cash fake-watches replica-bags cheap-replica cheap-followers buy-likes warez-world crack-keygen
serial-crackz torrent-movies free-iphone-win lottery-winner prize-claim malware-drop phish-login hacked-accounts account-verify
ads-server ad-tracker track-pixel banner-ads popup-ads-network discount-pharmacy canadian-meds weight-loss-pills buy-pills-now
cheap-viagra-store keto-diet-offer bonus-casino blackjack-table jackpot-city lucky-slots betting-tips-vip football-bets hot-singles
adult-dating sexy-girls-online nude-live-chat xxx-movies free-sex-clips cash-advance instant-loan-approval double-your-money
forex-profit-bot crypto-giveaway win-free-gift prize-winner free-giftcards replica-handbags fake-designer-shop followers-for-sale
buy-backlinks spam-mailer mass-mail-sender pirate-movies cracked-software keygen-download free-serials phishing-kit account-hack
virus-alert-fix click-tracker ads-exchange popunder-ads""".split()
ALLOWED_SITES = """news daily-news evening-post weather-report city-library university-press science-journal health-clinic museum
gardening recipes travel-guide history-notes open-data docs wiki forum photo-blog tech-review music-school sports-club car-repair
bookshop kindergarten town-council river-walk mountain-hut hiking chess-club bakery organic-farm bike-rental film-review
language-course school-paper pharmacy-museum green-energy north-harbour castle-tours stone-bridge old-mill silver-lake blue-heron
winter-sports summer-camp lighthouse orchard violin-makers astronomy geology ornithology mathematics linguistics theatre opera
cathedral monastery railway tramway airport ferry-lines post-office fire-brigade parliament ministry embassy statistics archive
almanac dictionary thesaurus encyclopedia atlas herald tribune gazette chronicle observer courier sentinel ledger register
bibliotheque jardin-botanique cuisine-facile marche-du-livre bahnhof stadtwerke buchhandlung wetterdienst gemeinde ayuntamiento
biblioteca periodico senderismo cocina-casera bluebird-cafe lakeside-dental maple-carpentry pixel-studio quiet-rooms red-barn-music
garden-centre plumbing-supplies hardware-store furniture-maker coffee-roasters tea-house pottery-class knitting-circle dance-academy
swimming-pool rowing-club cycling-routes marathon-training yoga-studio veterinary-practice animal-shelter bee-keeping dog-training
horse-riding sailing-school fishing-report camping-site youth-hostel guest-rooms city-map bus-timetable road-works parking-guide
tax-office job-board career-advice law-firm notary insurance-advice housing-cooperative real-estate architects structural-engineering
physics-lab chemistry-teacher biology-notes economics-review philosophy-today poetry-magazine short-stories comics-archive radio-drama
jazz-festival choir-practice guitar-lessons piano-tuning film-club photo-contest art-gallery design-week fashion-blog recipe-box
vegan-kitchen wine-cellar cheese-dairy fruit-growers seed-bank tree-nursery forest-rangers wind-turbines solar-roof water-board
recycling-centre volunteer-fund scout-group parish-church""".split()
#: Pages of every kind of site; those of the blocked ones besides.
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), ("com", "net", "org")
PATHS = (
    "/", "/about", "/contact.html", "/index.php", "/news/2021/03/annual-report", "/products/item-4471", "/articles/how-to-plant-roses", "/docs/guide/install", "/team/maria", "/search",
    "/events/summer", "/2019/11/24/first-snow", "/category/tools", "/blog/post-88", "/images/map.png", "/impressum",
)
BLOCKED_PATHS = ("/buy/cheap", "/win/now", "/casino/bonus", "/xxx/12")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#``; path from there up to ``?``, ``#``.

    Both are empty for a null URL or one without ``://``.
    """
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits and its verdict; null where none does.

    Of equally long rules the first in text order wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, to in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(to)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each text with its mark before it and an end mark behind it.

    A text is cut into letters once, so that the time is linear in its length.
    """

    def grams(text: Column, mark: str) -> Column:
        letters = F.split(F.concat(F.lit(mark), text, F.lit("$")), "")
        of = lambda all_, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_) - F.lit(n - 1), F.lit(1))), lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(all_, i, n), ""), F.lit(mark)), F.lit(BUCKETS)).cast("int"))
        return F.element_at(F.transform(F.array(letters), lambda all_: F.concat(*[of(all_, n) for n in GRAMS])), 1)

    return F.concat(grams(host, "^"), grams(path, ">"))


@cache
def _fit(rows: tuple[tuple[tuple[int, ...], int], ...], steps: int, ridge: float, prior: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on the rows' inner products; a row's features are its n-grams' shares.

    The bias is held at the log-odds of ``prior``, so that a URL of unknown n-grams is as likely to be blocked as that.
    """
    used = np.array(sorted({b for buckets, _ in rows for b in buckets}))
    x, y = np.zeros((len(rows), len(used))), np.array([label for _, label in rows], float)
    for i, (buckets, _) in enumerate(rows):
        np.add.at(x[i], np.searchsorted(used, buckets), 1 / len(buckets))
    inner, bias = x @ x.T, float(np.log(prior / (1 - prior)))
    duals = np.zeros(len(rows))
    for _ in range(steps):
        z = inner @ duals
        p = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        duals = np.linalg.solve(inner + ridge * np.diag(1 / w), z + (y - p) / w)
    weights = np.zeros(BUCKETS)
    weights[used] = x.T @ duals
    return weights, bias


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (site, url, label): label 1 is to be blocked. Its size is fixed."""
    rows = []
    for label, sites, more in ((1, BLOCKED_SITES, BLOCKED_PATHS), (0, ALLOWED_SITES, ())):
        for i, site in enumerate(sites):  # no ending goes with one label
            for j, pre in enumerate(PREFIXES):
                rows.append((site, f"http://{pre}{site}.example.{ENDINGS[(i + j) % len(ENDINGS)]}{PATHS[(i + 3 * j) % len(PATHS)]}", label))
            rows += [(site, f"https://{site}.example.{ENDINGS[(i + j) % len(ENDINGS)]}{path}", label) for j, path in enumerate(more)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{site}', '{url}', {label})" for site, url, label in rows) + " AS t(site, url, label)")


def train_urls(labelled: DataFrame, *, steps: int = 20, ridge: float = 0.001, prior: float = 0.2, max_rows: int = 2_000) -> tuple[np.ndarray, float]:
    """Weights by bucket and a bias, from at most ``max_rows`` labelled URLs (the first by URL)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("url", "label").orderBy("url", "label").limit(max_rows).select(gram_buckets(host, path).alias("b"), "label").collect()
    return _fit(tuple((tuple(r["b"]), int(r["label"])) for r in rows), steps, ridge, prior)


def url_score(buckets: Column, weights: np.ndarray, bias: float) -> Column:
    """Probability that a URL is to be blocked, from a column with its :func:`gram_buckets`."""
    held = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.element_at(held, b + 1))
    return 1 / (1 + F.exp(-(total / F.size(buckets) + F.lit(float(bias)))))


def judge_urls(pages: DataFrame, *, rules=RULES, model: tuple[np.ndarray, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the model's score.

    A rule decides where one fits, else the model: ``block`` at ``threshold`` or more. A null URL or one without
    ``://`` has empty host and path and is judged by the model on those. One output row per input row; repeated rows
    stay; other columns are ignored; an empty table gives no rows. One pass without a shuffle.
    """
    weights, bias = model or train_urls(labelled_urls(pages.sparkSession))
    parsed = pages.select("page_id", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)])
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    with_grams = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), gram_buckets(F.col("host"), F.col("path")).alias("buckets"))
    scored = with_grams.select("page_id", "host", "path", "rule", "by_rule", url_score(F.col("buckets"), weights, bias).alias("score"))
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules and the model."""
    return judge_urls(table(spark, sf_dir, "pages"))
