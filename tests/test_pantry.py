from pyspark.sql import functions as F

from larder.operators import pantry as pt


def test_standardize_unit_rule_order(spark):
    cases = [(2.0, "cups", "whole milk", 1000.0, "ml"),      # K19: liquid in a container beats the cup factor
             (1.0, "cup", "rice", 236.59, "ml"),
             (2.0, "can", "beans", 710.0, "ml"),
             (1.0, "box of cans", "sparkling water", 500.0, "ml"),  # container rule skipped (box), liquid rule applies
             (1.0, "box of cans", "beans", 1.0, "pieces"),
             (1.0, "jug", "water", 500.0, "ml"),
             (2.0, " LBS ", "chicken", 907.18, "gm"),
             (3.0, "fl oz", "juice", 88.72, "ml"),
             (1.0, "bunch", "kale", 1.0, "pieces"),
             (1.5, "bottle", "oil", 750.0, "ml"),
             (0.3333, "kg", "flour", 333.3, "gm")]
    df = spark.createDataFrame([c[:3] for c in cases], "q double, u string, item string")
    got = [(r.s.std_quantity, r.s.std_unit) for r in df.select(pt.standardize_unit(F.col("q"), F.col("u"), F.col("item")).alias("s")).collect()]
    assert got == [(c[3], c[4]) for c in cases]


def test_shopping_consolidation(spark):
    schema = "plan_id long, category string, item string, quantity_to_purchase string, total_quantity_needed string, unit string, pos long"
    b1 = spark.createDataFrame([(1, "produce", "Apple", "2", "3", "pcs", 1), (1, "produce", "apple", "1", "1", "pcs", 2),
                                (1, "proteins", "Tofu", "some", "1", "g", 3), (1, "grains", "Rice", "1", "1", "kg", 4),
                                (1, "pantry", "Salt", "2", "none", "g", 5), (1, "pantry", "Oil", None, "4", "l", 6)], schema)
    b2 = spark.createDataFrame([(1, "produce", "APPLE", "5", "5", "kg", 1), (1, "proteins", "tofu", "2", "2", "g", 2),
                                (1, "fruits", "Pear", "1", "2", "pcs", 3), (1, "snacks", "Chips", "1", "1", "bag", 4),
                                (1, "pantry", "salt", "3", "1", "g", 5), (1, "pantry", "salt", "few", "9", "g", 6), (1, "pantry", "oil", "1", "x", "l", 7),
                                (1, "fruits", "Fig", "few", "2", "pcs", 8), (1, "fruits", "fig", "1", "2", "pcs", 9),
                                (1, "fruits", "pear", "4", None, "pcs", 10)], schema)
    got = sorted((r.category, r.item, r.quantity_to_purchase, r.total_quantity_needed, r.source_batch)
                 for r in pt.shopping_consolidation(b1, b2).collect())
    assert got == [("fruits", "Fig", "few", "2", 2),  # nothing is added to a base that is no number
                   ("fruits", "Pear", "5.0", "2.0", 2),  # a missing total counts as 0
                   ("grains", "Rice", "1", "1", 1),
                   ("pantry", "Oil", "1.0", "4", 1),  # missing quantity 0; the total that is no number is skipped
                   ("pantry", "Salt", "5.0", "none", 1),  # the row with 'few' is skipped, the other counts
                   ("produce", "Apple", "2", "3", 1),
                   ("produce", "apple", "6.0", "6.0", 1),  # last batch-1 row of the name takes the sum (K9)
                   ("proteins", "Tofu", "some", "1", 1)]   # non-numeric: batch 1 kept


def test_normalize_inventory(spark):
    texts = [(1, 'x ```json\n[{"item_name": "Milk", "quantity": 2, "unit": "l", "category": "Beverages"}]\n``` y'),
             (2, '{"item_name": "Eggs", "category": "Eggs"}'),
             (3, "I see a fridge full of things that I cannot read at all, sorry about that"),
             (4, '[{"item_name": "Oil", "quantity": "2"}, {"item_name": "Salt", "quantity": "two"}]')]
    df = spark.createDataFrame(texts, "reply_id long, content string")
    got = sorted(tuple(r[1:]) for r in pt.normalize_inventory(df).select("reply_id", "reply_id", "item", "quantity", "unit", "category").collect())
    assert got == [(1, "Milk", 2.0, "l", "Beverages"), (2, "Eggs", 1.0, "unit", "Other"),
                   (3, texts[2][1][:50], 1.0, "unit", "Other"), (4, texts[3][1][:50], 1.0, "unit", "Other")]


def test_inventory_category_counts(spark):
    inv = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "y", ""), ("c", 1, "z", "Dairy"), ("d", 2, "w", "Dairy")],
                                "inventory_id string, user_id long, item_name string, category string")
    got = sorted(tuple(r) for r in pt.category_item_counts(inv).select("user_id", "category", "n_items", "total_items").collect())
    assert got == [(1, "Dairy", 1, 3), (1, "Other", 2, 3), (2, "Dairy", 1, 1)]


def test_shopping_totals(spark):
    schema = "plan_id long, total_estimated_cost double, total_items_from_inventory long, total_items_to_purchase long"
    a = spark.createDataFrame([(1, 2.5, 3, 4), (2, None, 1, 1)], schema)
    b = spark.createDataFrame([(1, 1.0, None, 6), (9, 1.0, 1, 1)], schema)
    assert sorted(tuple(r) for r in pt.shopping_totals(a, b).collect()) == [(1, 3.5, 3, 10), (2, 0.0, 1, 1)]
