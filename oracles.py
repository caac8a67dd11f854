"""SQL that states what each query must return, for an independent engine."""

from __future__ import annotations

import math

from ratingloom.functions.hashing import PRIME, ROUND_ONE, ROUND_TWO, SALT_SPREAD, SPREAD

GROUPS = 44
SLICE = 256
DENSE_DISTANCE = 1.25
SPARSE_DISTANCE = 1.3
FAR_DISTANCE = 1.45
FAR_TABLES = 2
DIMS = 64
DENSE_BUCKET = 0.1
FAR_BUCKET = 0.002
TABLES = 8
BUCKET = 1.5
SEED = 42
COPY = 1_000_000
OVERLAP = "is_test OR (userId + itemId) % 7 = 0"
KMEANS_ROUNDS = 20
PARALLEL_K = 12
PARALLEL_ITERATIONS = 3


def ratings(item: str = "l_partkey", test: str = "is_test", copies: bool = False) -> str:
    """Ratings and their split; ``test`` chooses the test rows, ``copies`` adds a copy of every tenth item to train."""
    spread = mixed(f"({mixed('userId', 2 * SEED)} + itemId % 2147483648)", 2 * SEED + 1)
    copied = f" UNION ALL SELECT userId, itemId + {COPY}, rating FROM marked WHERE NOT is_test AND itemId % 10 = 0"
    return f"""ratings AS MATERIALIZED (
  SELECT CAST(o_custkey AS BIGINT) AS userId, CAST({item} AS BIGINT) AS itemId,
         max(CAST(ceil(l_quantity / 5) AS DOUBLE) / 2) AS rating
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  GROUP BY o_custkey, {item}),
marked AS MATERIALIZED (
  SELECT *, ({spread}) % 10 = 0 AS is_test FROM ratings),
train AS MATERIALIZED (SELECT userId, itemId, rating FROM marked WHERE NOT is_test{copied if copies else ""}),
test AS MATERIALIZED (SELECT userId, itemId, rating FROM marked WHERE {test})"""


def items(group: str = "0") -> str:
    """Item vectors by group."""
    return f"""items AS MATERIALIZED (
  SELECT itemId AS item, CAST({group} AS BIGINT) AS grp, list(row(userId, rating) ORDER BY userId) AS v,
         sum(rating * rating) AS norm2, count(*) AS n_raters
  FROM train GROUP BY itemId HAVING sum(rating * rating) > 0),
weights AS MATERIALIZED (
  SELECT t.userId, t.itemId AS item, t.rating, rating / sqrt(norm2) AS weight, norm2, n_raters, grp
  FROM train t JOIN items ON t.itemId = items.item)"""


COSINES = """cosines AS MATERIALIZED (
  SELECT a.item AS i, b.item AS j, any_value(a.grp) AS grp, count(*) AS n_common,
         sum(a.rating * b.rating) / sqrt(any_value(a.norm2) * any_value(b.norm2)) AS cosine_sim
  FROM weights a JOIN weights b ON a.userId = b.userId AND a.grp = b.grp AND a.item < b.item
  GROUP BY a.item, b.item)"""

SYMMETRIC = """similarities AS MATERIALIZED (
  SELECT i, j, cosine_sim FROM cosines UNION ALL SELECT j, i, cosine_sim FROM cosines)"""

NEIGHBORS = """neighbors AS MATERIALIZED (
  SELECT t.userId, t.itemId AS target_item, t.rating AS actual_rating, r.itemId AS neighbor_item,
         s.cosine_sim, r.rating AS neighbor_rating
  FROM test t JOIN train r ON t.userId = r.userId
  JOIN similarities s ON s.i = t.itemId AND s.j = r.itemId),
sums AS MATERIALIZED (
  SELECT userId, target_item, actual_rating, sum(cosine_sim * neighbor_rating) AS weighted_rating_sum,
         sum(abs(cosine_sim)) AS similarity_sum
  FROM neighbors GROUP BY userId, target_item, actual_rating),
scored AS MATERIALIZED (
  SELECT userId, target_item AS itemId, weighted_rating_sum / similarity_sum AS pred_rating, actual_rating
  FROM sums WHERE similarity_sum > 0)"""

SCORED = "SELECT userId, itemId, round(pred_rating, 6) AS pred_rating, actual_rating FROM scored"


def mixed(key: str, salt: int) -> str:
    s = salt % 1000003
    start = f"((({key}) % {PRIME}) * {SPREAD} + {s * SALT_SPREAD + 12345}) % {PRIME}"
    once = f"list_transform([{start}], lambda h: (h * h + h * {ROUND_ONE} + {s}) % {PRIME})[1]"
    return f"list_transform([{once}], lambda h: (h * h + h * {ROUND_TWO} + 1) % {PRIME})[1]"


def uniform(key: str, salt: int) -> str:
    return f"((CAST({mixed(key, salt)} AS DOUBLE) + 0.5) / {float(PRIME)})"


def gaussian(key: str, stream: int, seed: int = SEED) -> str:
    salt = seed * 1009 + 2 * stream
    return f"sqrt(-2.0 * ln({uniform(key, salt)})) * cos({2.0 * math.pi!r} * {uniform(key, salt + 1)})"


def hashes(tables: int = TABLES, bucket: float = BUCKET) -> str:
    axes = " UNION ALL ".join(f"SELECT userId, {t} AS t, {gaussian('userId', t)} AS g FROM users" for t in range(tables))
    return f"""users AS (SELECT DISTINCT userId FROM weights),
axes AS MATERIALIZED ({axes}),
lengths AS (SELECT t, sqrt(sum(g * g)) AS len FROM axes GROUP BY t),
hashes AS MATERIALIZED (
  SELECT item, t, CAST(floor(sum(weight * g) / any_value(len) / {bucket}) AS INTEGER) AS bucket
  FROM weights JOIN axes USING (userId) JOIN lengths USING (t) GROUP BY item, t)"""


def near(max_distance: float) -> str:
    return f"""near AS MATERIALIZED (
  SELECT * FROM (
    SELECT i, j, sqrt(greatest(2.0 - cosine_sim * 2, 0.0)) AS distance FROM cosines)
  WHERE distance < {max_distance} AND EXISTS (
    SELECT 1 FROM hashes x JOIN hashes y ON x.t = y.t AND x.bucket = y.bucket
    WHERE x.item = i AND y.item = j))"""


# Pairs from the buckets themselves; those without a common rater have cosine zero.
BUCKET_NEAR = """met AS MATERIALIZED (
  SELECT DISTINCT x.item AS i, y.item AS j FROM hashes x JOIN hashes y ON x.t = y.t AND x.bucket = y.bucket AND x.item < y.item),
near AS MATERIALIZED (
  SELECT * FROM (
    SELECT met.i, met.j, sqrt(greatest(2.0 - 2 * coalesce(dots.dot, 0), 0.0)) AS distance
    FROM met LEFT JOIN (
      SELECT a.item AS i, b.item AS j, sum(a.rating * b.rating) / sqrt(any_value(a.norm2) * any_value(b.norm2)) AS dot
      FROM met JOIN weights a ON a.item = met.i JOIN weights b ON b.item = met.j AND b.userId = a.userId
      GROUP BY a.item, b.item) dots ON dots.i = met.i AND dots.j = met.j)
  WHERE distance < {0})""".format


NEW_ITEMS = """new_weights AS MATERIALIZED (
  SELECT userId, itemId, rating / sqrt(sum(rating * rating) OVER (PARTITION BY itemId)) AS weight FROM (
    SELECT CAST(o_custkey AS BIGINT) AS userId, CAST(l_suppkey AS BIGINT) AS itemId,
           max(CAST(ceil(l_quantity / 5) AS DOUBLE) / 2) AS rating
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey))"""

DENSE_ENTRIES = """entries AS MATERIALIZED (
  SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
norms AS (SELECT vec_id, sqrt(sum(value * value)) AS norm FROM entries GROUP BY vec_id)"""


def parallel_start(k: int, rounds: int, seed: int = SEED) -> str:
    """An oversampled start unrolled: rounds of draws by squared distance, then the candidates reduced by doubling."""
    parts = ["firsts AS MATERIALIZED (SELECT min(item) AS item, CAST(count(*) AS BIGINT) AS copies FROM items GROUP BY v)"]

    def drawn(name: str, rows: str, rate: str, n: int, salt: int, so_far: str | None, have: int) -> None:
        more = f"""SELECT item, {have} + row_number() OVER (ORDER BY -ln({uniform('item', salt)}) / rate, item) - 1 AS cluster
  FROM (SELECT item, {rate} AS rate FROM {rows}) WHERE rate > 0 QUALIFY cluster < {have + n}"""
        parts.append(f"{name} AS MATERIALIZED ({'SELECT * FROM ' + so_far + ' UNION ALL ' if so_far else ''}{more})")

    def measured(name: str, pool: str, chosen: str) -> None:
        step = "CAST(floor((2.0 - 2.0 * {}) / 1e-9 + 0.5) AS BIGINT)".format
        parts.append(f"""{name} AS MATERIALIZED (
  SELECT item, any_value(copies) AS copies, greatest(min(offer) // 65536, 0) AS steps, min(offer) % 65536 AS cluster FROM (
    SELECT a.item, p.copies, {step('sum(a.weight * b.weight)')} * 65536 + cluster AS offer
    FROM {pool} p JOIN weights a ON a.item = p.item JOIN weights b ON b.userId = a.userId JOIN {chosen} c ON c.item = b.item
    GROUP BY a.item, p.copies, cluster
    UNION ALL SELECT item, copies, {step('0.0')} * 65536 FROM {pool})
  GROUP BY item)""")

    have = 1
    drawn("s0", "firsts", "copies", 1, seed, None, 0)
    for r in range(rounds):
        measured(f"g{r}", "firsts", f"s{r}")
        drawn(f"s{r + 1}", f"g{r}", "copies * steps", 2 * k, seed + 1 + r, f"s{r}", have)
        have += 2 * k
    measured("loads", "firsts", f"s{rounds}")
    parts.append(f"""pool AS MATERIALIZED (
  SELECT s{rounds}.item, copies FROM s{rounds} JOIN (SELECT cluster, sum(copies) AS copies FROM loads GROUP BY cluster) USING (cluster))""")
    drawn("c1", "pool", "copies", 1, seed + 1 + rounds, None, 0)
    have = 1
    while have < k:
        more = min(have, k - have)
        measured(f"h{have}", "pool", f"c{have}")
        drawn(f"c{have + more}", f"h{have}", "copies * steps", more, seed + 1 + rounds + have, f"c{have}", have)
        have += more
    parts.append(f"a0 AS MATERIALIZED (SELECT item, cluster FROM c{k})")
    return ",\n".join(parts)


def weighted_start(seed: int = SEED) -> str:
    return f"""draws AS (
  SELECT item, row_number() OVER (ORDER BY -ln({uniform('item', seed)}) / n, item) - 1 AS cluster
  FROM (SELECT min(item) AS item, max(n_raters) * count(*) AS n FROM items GROUP BY v)),
a0 AS MATERIALIZED (
  SELECT item, cluster FROM draws
  WHERE cluster < (SELECT greatest(10, least(100, floor(sqrt(count(*))))) FROM items))"""


def clusters(rounds: int = KMEANS_ROUNDS, seed: int = SEED, start: str | None = None) -> str:
    """KMeans unrolled: centres of an assignment, then the nearest centre of every item."""
    parts = [start or weighted_start(seed)]
    for r in range(rounds):
        step = "CAST(floor((1.0 + norm2 - 2.0 * {dot}) / 1e-9 + 0.5) AS BIGINT) * 65536 + cluster"
        parts.append(
            f"""m{r} AS MATERIALIZED (
  SELECT cluster, userId, sum(weight) / any_value(size) AS value
  FROM weights JOIN a{r} USING (item)
  JOIN (SELECT cluster, count(*) AS size FROM a{r} GROUP BY cluster) USING (cluster)
  GROUP BY cluster, userId),
n{r} AS MATERIALIZED (SELECT cluster, sum(value * value) AS norm2 FROM m{r} GROUP BY cluster),
d{r} AS MATERIALIZED (
  SELECT item, cluster, sum(weight * value) AS dot FROM weights JOIN m{r} USING (userId) GROUP BY item, cluster),
a{r + 1} AS MATERIALIZED (
  SELECT item, min(offer) % 65536 AS cluster FROM (
    SELECT item, {step.format(dot="dot")} AS offer FROM d{r} JOIN n{r} USING (cluster)
    UNION ALL
    SELECT item, (SELECT min({step.format(dot="0.0")}) FROM n{r}) FROM (SELECT DISTINCT item FROM weights))
  GROUP BY item)"""
        )
    parts.append(f"clusters AS MATERIALIZED (SELECT item, CAST(cluster AS INTEGER) AS cluster FROM a{rounds})")
    return ",\n".join(parts)


def with_(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


def oracle_sql() -> dict[str, str]:
    base = ratings()
    dense = ratings("l_suppkey")
    grouped = items(f"itemId % {GROUPS}")
    pair = "SELECT i, j, round(cosine_sim, 6) AS cosine_sim FROM"
    exact = [base, items(), COSINES, SYMMETRIC, NEIGHBORS]
    by_group = [base, grouped, COSINES, SYMMETRIC, NEIGHBORS]
    errors = """SELECT count(*) AS n_scored, round(sqrt(avg(power(pred_rating - actual_rating, 2))), 6) AS rmse,
  round(avg(abs(pred_rating - actual_rating)), 6) AS mae FROM scored"""
    near_cosines = "cosines_near AS (SELECT i, j, 1 - power(distance, 2) / 2 AS cosine_sim FROM near)"
    lsh_similarities = """similarities AS MATERIALIZED (
  SELECT i, j, cosine_sim FROM cosines_near UNION ALL SELECT j, i, cosine_sim FROM cosines_near)"""
    near_final = "SELECT i, j, round(distance, 6) AS distance FROM near"
    in_cluster = f"""clustered_cosines AS MATERIALIZED (
  SELECT i, j, cosine_sim FROM cosines JOIN clusters a ON i = a.item JOIN clusters b ON j = b.item
  WHERE a.cluster = b.cluster),
{SYMMETRIC.replace("FROM cosines", "FROM clustered_cosines")}"""
    raw = """SELECT CAST(o_custkey AS BIGINT) AS userId, CAST(l_partkey AS BIGINT) AS "movieId",
  CAST(ceil(l_quantity / 5) AS DOUBLE) / 2 AS rating,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS "timestamp"
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
    lsh_dense = with_(dense, items(), COSINES, hashes(), near(DENSE_DISTANCE), final=near_final)
    exact_final = with_(*exact, final=SCORED)
    copied, copied_dense = ratings(copies=True), ratings("l_suppkey", copies=True)
    overlap = ratings(test=OVERLAP)
    lsh = [base, items(), COSINES, hashes(), near(SPARSE_DISTANCE), near_cosines, lsh_similarities, NEIGHBORS]
    cluster = [base, items(), COSINES, clusters(), in_cluster, NEIGHBORS]
    nothing = "CAST(NULL AS {0})".format

    def summary(similarity: str, clustering: str = nothing("VARCHAR"), threshold: str = nothing("DOUBLE"),
                tables: str = nothing("INTEGER"), bucket: str = nothing("DOUBLE")) -> str:
        return f"""SELECT 'orders' AS "Dataset", (SELECT count(*) FROM train) AS "Train Size",
  (SELECT count(*) FROM test) AS "Test Size", '{similarity}' AS "Similarity", {clustering} AS "Clustering",
  {threshold} AS "Similarity Threshold", {tables} AS "Num Hash Tables", {bucket} AS "Bucket Length",
  count(*) AS "Scored Rows", round(sqrt(avg(power(pred_rating - actual_rating, 2))), 6) AS "RMSE",
  round(avg(abs(pred_rating - actual_rating)), 6) AS "MAE" FROM scored"""

    last = KMEANS_ROUNDS - 1
    offer = "CAST(floor((1.0 + norm2 - 2.0 * {0}) / 1e-9 + 0.5) AS BIGINT) * 65536 + cluster".format
    dense_axes = " UNION ALL ".join(
        f"SELECT idx, {t} AS t, {gaussian('idx', t)} AS g FROM (SELECT unnest(range({DIMS})) AS idx)" for t in range(TABLES)
    )
    k = "(SELECT CAST(greatest(10, least(100, floor(sqrt(count(*))))) AS INTEGER) FROM items)"
    return {
        "scan_ratings": with_(base, final="SELECT userId, itemId, rating FROM ratings"),
        "convert_dat": raw,
        "preview": with_(base, final="SELECT userId, itemId, rating FROM ratings ORDER BY userId, itemId LIMIT 5"),
        "train_split": with_(base, final="SELECT userId, itemId, rating FROM train"),
        "test_split": with_(base, final="SELECT userId, itemId, rating FROM test"),
        "split_sizes": with_(base, final="SELECT is_test, count(*) AS n_rows FROM marked GROUP BY is_test"),
        "dataset_stats": with_(
            base,
            final="""SELECT count(*) AS n_ratings, round(avg(rating), 6) AS avg_rating, min(rating) AS min_rating,
  max(rating) AS max_rating, count(DISTINCT userId) AS n_users, count(DISTINCT itemId) AS n_items FROM ratings""",
        ),
        "default_cluster_count": with_(
            base,
            final="""SELECT count(DISTINCT itemId) AS n_items,
  CAST(greatest(10, least(100, floor(sqrt(count(DISTINCT itemId))))) AS INTEGER) AS k FROM ratings""",
        ),
        "item_user_ratings": with_(
            base,
            final=f"""SELECT itemId, userId // {SLICE} AS slice, CAST(count(*) AS INTEGER) AS n_users,
  min(userId) AS first_user, max(userId) AS last_user, sum(rating) AS rating_sum
FROM train GROUP BY itemId, userId // {SLICE}""",
        ),
        "item_vectors": with_(base, final="SELECT itemId, userId AS idx, rating AS value FROM train"),
        "normalized_item_vectors": with_(
            base,
            final="""SELECT t.itemId, userId AS idx, round(rating / sqrt(n), 6) AS value
FROM train t JOIN (SELECT itemId, sum(rating * rating) AS n FROM train GROUP BY itemId) s ON t.itemId = s.itemId""",
        ),
        "item_cosine": with_(base, items(), COSINES, final=f"{pair} cosines"),
        "within_group_pairs": with_(base, grouped, COSINES, final="SELECT grp, i, j, n_common FROM cosines"),
        "within_group_cosine": with_(base, grouped, COSINES, final=f"{pair} cosines"),
        "symmetric_similarities": with_(base, grouped, COSINES, SYMMETRIC, final=f"{pair} similarities"),
        "lsh_item_hashes": with_(base, items(), hashes(), final="SELECT item AS itemId, t AS tbl, bucket FROM hashes"),
        "lsh_similarity_join": lsh_dense,
        "lsh_similarity_join_hot_users": lsh_dense,
        "lsh_similarity_join_buckets": with_(dense, items(), hashes(), BUCKET_NEAR(DENSE_DISTANCE), final=near_final),
        "lsh_similarity_join_far": with_(
            base, items(), hashes(FAR_TABLES, FAR_BUCKET), BUCKET_NEAR(FAR_DISTANCE), final=near_final
        ),
        "distance_to_cosine": with_(
            dense,
            items(),
            COSINES,
            hashes(),
            near(DENSE_DISTANCE),
            final="""SELECT i, j, round(distance, 6) AS distance, round(1 - power(distance, 2) / 2, 6) AS cosine_sim
FROM near""",
        ),
        "neighbor_ratings": with_(
            *by_group,
            final="""SELECT userId, target_item, neighbor_item, round(cosine_sim, 6) AS cosine_sim, neighbor_rating
FROM neighbors""",
        ),
        "weighted_rating_sums": with_(
            *by_group,
            final="""SELECT userId, target_item, round(weighted_rating_sum, 6) AS weighted_rating_sum,
  round(similarity_sum, 6) AS similarity_sum FROM sums""",
        ),
        "predict_ratings": with_(
            *by_group, final="SELECT userId, itemId, round(pred_rating, 6) AS pred_rating FROM scored"
        ),
        "scored_predictions": with_(*by_group, final=SCORED),
        "evaluate_predictions": with_(*exact, final=errors),
        "evaluate_predictions_dense": with_(dense, *exact[1:], final=errors),
        "exact_cf": exact_final,
        "exact_cf_hot_users": exact_final,
        "exact_cf_touched": exact_final,
        "exact_cf_wanted_pairs": exact_final,
        "group_cf": with_(*by_group, final=SCORED),
        "kmeans_item_clusters": with_(
            base,
            items(),
            clusters(),
            final="SELECT item AS itemId, cluster FROM clusters",
        ),
        "kmeans_parallel_start": with_(
            base,
            items(),
            clusters(PARALLEL_ITERATIONS, start=parallel_start(PARALLEL_K, 2)),
            final="SELECT item AS itemId, cluster FROM clusters",
        ),
        "cluster_cf": with_(*cluster, final=SCORED),
        "lsh_cf": with_(*lsh, final=SCORED),
        "experiment_summary": with_(*exact, final=summary("Cosine (exact)")),
        "experiment_summary_lsh": with_(
            *lsh,
            final=summary("Cosine (approximated with LSH)", threshold=f"CAST({SPARSE_DISTANCE} AS DOUBLE)",
                          tables=str(TABLES), bucket=f"CAST({BUCKET} AS DOUBLE)"),
        ),
        "experiment_summary_cluster": with_(
            *cluster, final=summary("Cosine (within cluster)", clustering=f"'KMeans (k=' || {k} || ')'")
        ),
        "named_datasets": with_(base, final="SELECT userId, itemId, rating FROM ratings"),
        "quarantined_lines": f"""SELECT CASE WHEN rating = 5 THEN 'rejected' ELSE 'clean' END AS kind, count(*) AS n_rows
FROM ({raw}) GROUP BY kind""",
        "assign_new_items": with_(base, items(), clusters(), NEW_ITEMS, final=f"""SELECT itemId, CAST(min(offer) % 65536 AS INTEGER) AS cluster
FROM (
  SELECT itemId, {offer("dot")} AS offer
  FROM (SELECT itemId, cluster, sum(weight * value) AS dot FROM new_weights JOIN m{last} USING (userId) GROUP BY itemId, cluster)
  JOIN n{last} USING (cluster)
  UNION ALL
  SELECT itemId, (SELECT min({offer("0.0")}) FROM n{last}) FROM (SELECT DISTINCT itemId FROM new_weights))
GROUP BY itemId"""),
        "lsh_hashes_of_new_items": with_(base, items(), hashes(), NEW_ITEMS, final=f"""SELECT itemId, t AS tbl,
  CAST(floor(sum(weight * g) / any_value(len) / {BUCKET}) AS INTEGER) AS bucket
FROM new_weights JOIN axes USING (userId) JOIN lengths USING (t) GROUP BY itemId, t"""),
        "dense_unit_vectors": f"""WITH {DENSE_ENTRIES}
SELECT vec_id, idx, round(value / norm, 6) AS value FROM entries JOIN norms USING (vec_id)""",
        "dense_lsh_hashes": f"""WITH {DENSE_ENTRIES}, axes AS ({dense_axes}),
lengths AS (SELECT t, sqrt(sum(g * g)) AS len FROM axes GROUP BY t)
SELECT vec_id, t AS tbl, CAST(floor(sum(value / norm * g / len) / {DENSE_BUCKET}) AS INTEGER) AS bucket
FROM entries JOIN norms USING (vec_id) JOIN axes USING (idx) JOIN lengths USING (t) GROUP BY vec_id, t""",
        "exact_cf_overlap": with_(overlap, *exact[1:], final=SCORED),
        "exact_cf_overlap_hot_users": with_(overlap, *exact[1:], final=SCORED),
        "exact_cf_copies": with_(copied, *exact[1:], final=SCORED),
        "exact_cf_copies_hot_users": with_(copied, *exact[1:], final=SCORED),
        "item_cosine_copies": with_(copied_dense, items(), COSINES, final=f"{pair} cosines"),
        "within_group_pairs_copies": with_(
            copied, grouped, COSINES, final="SELECT grp, i, j, n_common FROM cosines"
        ),
        "lsh_item_hashes_copies": with_(
            copied, items(), hashes(), final="SELECT item AS itemId, t AS tbl, bucket FROM hashes"
        ),
        "lsh_similarity_join_copies": with_(
            copied_dense, items(), COSINES, hashes(), near(DENSE_DISTANCE), final=near_final
        ),
        "kmeans_item_clusters_copies": with_(
            copied, items(), clusters(), final="SELECT item AS itemId, cluster FROM clusters"
        ),
    }
