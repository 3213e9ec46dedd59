"""Train/test parts and folds that never divide a group."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.operators.pool import today_text
from fieldsift.scale import hash_rank, materialise, ordered_rank, take_by_hash
from fieldsift.session import scratch_path


def latest_test_days(df: DataFrame, *, fraction: float = V.TEST_FRACTION, today: str | None = None) -> DataFrame:
    """(constrId, reportDate) of the test part: the last days of each site, one day always left to train.

    Future dates are never test days. Rows are reduced to distinct days before the window.
    """
    days = df.filter(F.col("reportDate") <= today_text(today)).select("constrId", "reportDate").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("constrId"))
    wanted = F.least(F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))), F.greatest(n - 1, F.lit(0)))
    back = F.row_number().over(Window.partitionBy("constrId").orderBy(F.col("reportDate").desc()))
    return days.filter("constrId is not null").withColumn("n", wanted).withColumn("back", back).filter("back <= n").select(
        "constrId", "reportDate"
    )


def with_part(df: DataFrame, test_days: DataFrame) -> DataFrame:
    """Add `part`: test on a test day, otherwise train."""
    marked = df.join(test_days.withColumn("__t", F.lit(True)), ["constrId", "reportDate"], "left")
    return marked.withColumn("part", F.when(F.col("__t"), F.lit("test")).otherwise(F.lit("train"))).drop("__t")


def _candidate_key() -> Column:
    return F.struct(
        (F.col("got") / F.col("cost")).alias("density"), "got", (-F.col("cost")).alias("cheap"), "constrId", "reportDate"
    )


#: The largest page of candidate days: pages grow up to it, so that their number stays small beside the days'.
MOST_PAGE = 1 << 14


class _Candidates:
    """Test days that hold a rare class, best first, fetched in pages from a stored table numbered in that order.

    Each page is a range of numbers, which the files' statistics lead to: no page sorts or reads the table again.
    """

    def __init__(self, table: DataFrame, page: int):
        numbered = ordered_rank(table.withColumn("k", F.struct("cls", _candidate_key().alias("key"))), "k", out="n").drop("k")
        path = scratch_path(table.sparkSession, "candidates")
        numbered.sortWithinPartitions("n").write.parquet(path)
        self.table = table.sparkSession.read.schema(numbered.schema).parquet(path)
        self.page: dict[str, int] = defaultdict(lambda: page)
        self.pages: dict[str, list] = {}
        ends = self.table.groupBy("cls").agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()  # rare classes only
        self.left = {r["cls"]: (r["least"], r["most"]) for r in ends}

    def _fetch(self, cls: str, quota: int) -> None:
        least, most = self.left[cls]
        first = max(least, most - self.page[cls] + 1)
        rows = self.table.filter(F.col("n").between(first, most) & (F.col("cost") <= quota))
        self.pages[cls] = sorted(rows.collect(), key=lambda r: r["n"])
        self.left[cls] = least, first - 1
        self.page[cls] = max(self.page[cls], min(MOST_PAGE, 2 * self.page[cls]))

    def best(self, cls: str, quota: int, usable) -> object | None:
        """The best day that can still move, given once. Whatever is unusable now stays so: quotas and sites only shrink."""
        while True:
            rows = self.pages.get(cls, [])
            while rows:
                if usable(day := rows.pop()):
                    return day
            least, most = self.left.get(cls, (1, 0))
            if most < least:
                return None
            self._fetch(cls, quota)


def rare_class_floor(
    df: DataFrame, test_days: DataFrame, *, floor: int = V.RARE_TRAIN_FLOOR, max_shrink: float = V.MAX_TEST_SHRINK, page: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Move whole test days back to train until every class has `floor` train rows, as far as affordable.

    Returns (test days that remain, moved days with class and gain). Counting runs on Spark over the
    site x day x class cube; the driver holds class totals and one page of candidate days per rare class.
    """
    spark = df.sparkSession
    marked = with_part(df, test_days)
    own = F.col("dataset") == V.GOLD_DATASETS[0] if "dataset" in df.columns else F.lit(True)
    cube = materialise(
        marked.groupBy(F.col("constrId").cast("string").alias("constrId"), F.col("reportDate").cast("string").alias("reportDate"), "cls", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("own"))
    )
    # rows of other datasets cost a day but do not feed a class
    per_class = cube.groupBy("cls").agg(F.sum(F.when(F.col("part") == "train", F.col("own")).otherwise(0)).alias("n"))
    train = {r["cls"]: r["n"] for r in per_class.filter(F.col("n") < floor).collect()}  # rare classes only
    test = cube.filter("part = 'test'")
    quota = int((test.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * max_shrink)
    moved: list[tuple] = []
    if train and quota > 0:
        rare = F.col("cls").isin(*train)
        cost = test.groupBy("constrId", "reportDate").agg(
            F.sum("n").alias("cost"),
            F.map_from_entries(F.collect_list(F.when(rare, F.struct("cls", "own")))).alias("mix"),
        )
        sites = cost.groupBy("constrId").agg(F.count(F.lit(1)).alias("site_days")).filter("site_days > 1")
        table = materialise(
            test.filter(rare).select("constrId", "reportDate", "cls", F.col("own").alias("got"))
            .filter("got > 0").join(cost, ["constrId", "reportDate"]).filter(F.col("cost") <= quota).join(sites, "constrId")
        )
        source = _Candidates(table, page)
        gone: set[tuple] = set()
        taken: dict[str, int] = defaultdict(int)
        stuck: set[str] = set()

        def usable(r) -> bool:
            return (
                r["cost"] <= quota
                and (r["constrId"], r["reportDate"]) not in gone
                and r["site_days"] - taken[r["constrId"]] > 1
            )

        while quota > 0:
            hungry = [c for c, n in train.items() if n < floor and c not in stuck]
            if not hungry:
                break
            cls = min(hungry, key=lambda c: (train[c], c))
            day = source.best(cls, quota, usable)
            if day is None:
                stuck.add(cls)
                continue
            quota -= day["cost"]
            taken[day["constrId"]] += 1
            if sum(n > 0 for n in day["mix"].values()) > 1:  # else no other class offers it again
                gone.add((day["constrId"], day["reportDate"]))
            for c, n in day["mix"].items():
                train[c] += n
            moved.append((day["constrId"], day["reportDate"], int(day["cost"]), cls, int(day["got"])))
    moves = spark.createDataFrame(moved, "constrId string, reportDate string, photos long, `for` string, gained long")
    left = test_days.join(
        moves.select(F.col("constrId").alias("__s"), F.col("reportDate").alias("__d")),
        (F.col("constrId").cast("string") == F.col("__s")) & (F.col("reportDate").cast("string") == F.col("__d")),
        "left_anti",
    )
    return left, moves


def assemble_split(df: DataFrame, test_days: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(fileId, part, cls, dataset). Crops of drawn boxes join train, and only when their photo is there."""
    photos = with_part(df, test_days)
    dataset = F.col("dataset") if "dataset" in df.columns else F.lit("pms")
    rows = photos.select("fileId", "part", "cls", dataset.alias("dataset"))
    if boxes is None:
        return rows
    crops = (
        photos.filter("part = 'train'").select("fileId", "cls").join(boxes, "fileId")
        .select("fileId", "cls", F.posexplode("boxes").alias("i", "b"))
        .select(
            F.concat("fileId", F.lit("#"), F.col("i").cast("string")).alias("fileId"), F.lit("train").alias("part"), "cls",
            F.lit("crop").alias("dataset"),
        )
    )
    return rows.unionByName(crops)


def split_counts(split: DataFrame) -> DataFrame:
    """Train and test rows per class; classes missing from test; classes tested on more than trained on."""
    per = split.groupBy("cls").agg(
        F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test")
    )
    return per.select(
        "cls", "train", "test", ((F.col("train") > 0) & (F.col("test") == 0)).alias("missing_in_test"),
        (F.col("train") < F.col("test")).alias("starved"),
    )


def split_problems(split: DataFrame, features: DataFrame) -> DataFrame:
    """What keeps a split from being trained on; empty when all is well."""
    facts = split.agg(
        F.count_if(F.col("part") == "train").alias("train"),
        F.count_if(F.col("part") == "test").alias("test"),
        F.count_distinct(F.when(F.col("part") == "train", F.col("cls"))).alias("classes"),
        F.count_if(~F.col("dataset").isin(*V.GOLD_DATASETS)).alias("foreign"),
    )
    bare = split.join(features.select("fileId"), "fileId", "left_anti").agg(F.count(F.lit(1)).alias("bare"))
    problems = F.array_compact(
        F.array(
            F.when((F.col("train") == 0) | (F.col("test") == 0), F.lit("train or test is empty")),
            F.when(F.col("classes") < 2, F.lit("fewer than two classes to train on")),
            F.when(F.col("foreign") > 0, F.lit("rows of another data source")),
            F.when(F.col("bare") > 0, F.concat(F.col("bare").cast("string"), F.lit(" rows without features"))),
        )
    )
    return facts.crossJoin(F.broadcast(bare)).select(F.explode(problems).alias("problem"))  # one row each


def _deal(loads: list[int], size: int, many: int) -> list[int]:
    """How many of `many` groups of `size` go to each fold when each goes to the lightest fold.

    Follows the one-by-one rule, but jumps: once all loads differ by less than `size`, whole
    rounds leave the picture unchanged.
    """
    k, dealt = len(loads), [0] * len(loads)
    heap = [(load, i) for i, load in enumerate(loads)]
    heapq.heapify(heap)
    while many:
        spread = max(heap)[0] - heap[0][0]
        if spread < size and many >= 2 * k:
            rounds = many // k - 1
            heap = [(load + rounds * size, i) for load, i in heap]
            dealt = [d + rounds for d in dealt]
            many -= rounds * k
            heapq.heapify(heap)
            continue
        load, i = heapq.heappop(heap)
        gap = heap[0][0] - load if heap else 0
        step = min(many, max(1, -(-gap // size)))
        dealt[i] += step
        many -= step
        heapq.heappush(heap, (load + step * size, i))
    for load, i in heap:
        loads[i] = load
    return dealt


def group_folds(df: DataFrame, group: str, folds: int = V.OOF_FOLDS) -> DataFrame:
    """(group, fold): largest groups first, each to the fold that is lightest so far.

    Groups of equal size are interchangeable, so the driver only deals out the histogram of sizes;
    which group of a size gets which fold follows the hash order of its name.
    """
    sizes = materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("size")))
    histogram = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.col("size").desc()).collect()
    total = sum(r["groups"] for r in histogram)
    k = min(folds, total)
    if k < 2:
        raise ValueError("at least two groups are needed")
    loads, rows = [0] * k, []
    for r in histogram:
        ends, end = [], 0
        for n in _deal(loads, r["size"], r["groups"]):
            end += n
            ends.append(end)
        rows.append((r["size"], ends))
    ends = df.sparkSession.createDataFrame(rows, "size long, ends array<long>")
    ranked = hash_rank(sizes, ["size"], group)
    fold = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    return ranked.join(ends, "size").select(group, "size", fold.alias("fold"))


def stratified_group_folds(df: DataFrame, group: str, positive: str, folds: int = V.OOF_FOLDS, seed: int = 0) -> DataFrame:
    """(group, fold) with positives spread evenly. `seed` changes which like groups go where.

    Groups with the same (rows, positives) are interchangeable: each such kind is dealt evenly, and
    the remainder goes, most positives first, to the folds with the fewest positives, then rows.
    """
    sizes = materialise(
        df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col(positive).cast("long")).alias("hits"))
    )
    kinds = sizes.groupBy("size", "hits").agg(F.count(F.lit(1)).alias("groups")).orderBy(
        F.col("hits").desc(), F.col("size").desc()
    ).collect()
    k = min(folds, sum(r["groups"] for r in kinds))
    if k < 2:
        raise ValueError("at least two groups are needed")
    state = [[0, 0, i] for i in range(k)]
    rows = []
    for r in kinds:
        dealt = [r["groups"] // k] * k
        for fold in state:
            fold[0] += dealt[0] * r["hits"]
            fold[1] += dealt[0] * r["size"]
        for _ in range(r["groups"] % k):
            fold = min(state)
            dealt[fold[2]] += 1
            fold[0] += r["hits"]
            fold[1] += r["size"]
        ends, end = [], 0
        for n in dealt:
            end += n
            ends.append(end)
        rows.append((r["size"], r["hits"], ends))
    ends = df.sparkSession.createDataFrame(rows, "size long, hits long, ends array<long>")
    ranked = hash_rank(sizes, ["size", "hits"], group, seed=f"{seed}:")
    fold = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    return ranked.join(ends, ["size", "hits"]).select(group, "size", "hits", fold.alias("fold"))


def audit_pick(file_id: Column, percent: int = V.AUDIT_PERCENT) -> Column:
    """A fixed share of ids, the same ones every day."""
    return F.conv(F.substring(F.sha2(file_id, 256), 1, 8), 16, 10).cast("long") % 100 < percent


def train_val_groups(df: DataFrame, group: str, fraction: float, identity: str = "fileId", seed: str = "") -> DataFrame:
    """Add `part` (train or val) by whole groups; a single group falls back to single photos, flagged."""
    groups = df.select(group).distinct()
    n = groups.count()
    degenerate = n < 2
    unit = identity if degenerate else group
    units = df.select(unit).distinct() if degenerate else groups
    total = units.count() if degenerate else n
    wanted = round(total * fraction) if degenerate else max(1, round(total * fraction))
    quota = df.sparkSession.createDataFrame([(1, wanted)], "one int, quota long")
    val = take_by_hash(units.withColumn("one", F.lit(1)), ["one"], unit, F.broadcast(quota), seed=seed)
    marked = df.join(val.select(unit, F.lit(True).alias("__v")), unit, "left")
    return marked.withColumn("part", F.when(F.col("__v"), F.lit("val")).otherwise(F.lit("train"))).withColumn(
        "degenerate", F.lit(degenerate)
    ).drop("__v")
