"""Captured cards arriving as files, processed with foreachBatch."""

import os

from stayspark.sources.market_store import current_listings
from stayspark.streaming.listings import start_listing_upsert

SCHEMA = ("title_raw string, price_raw string, text string, href string, checkin string, checkout string, "
          "ciudad string, propiedad_referencia string, scraped_on string")


def test_stream_upsert(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    rows = [("Casa Sol", "300 € en total", "Casa entera\n4,90 (12)", "/rooms/1", "2026-07-15", "2026-07-18",
             "Valencia", "P", "2026-07-01"),
            ("Casa Luna", "90 €", "Cabaña", "/rooms/2", "2026-07-15", "2026-07-16", "Valencia", "P", "2026-07-01")]
    spark.createDataFrame(rows, SCHEMA).write.json(os.path.join(src, "b0"))
    stream = spark.readStream.schema(SCHEMA).json(src + "/*")
    q = start_listing_upsert(stream, os.path.join(tmpdir_path, "store"), os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    store = os.path.join(tmpdir_path, "store")
    got = {r.url: r.precio_noche for r in current_listings(spark, store, ["fecha_scraping"]).collect()}
    assert got == {"https://www.airbnb.es/rooms/1": 100, "https://www.airbnb.es/rooms/2": 90}
    # a new checkpoint starts batch numbers anew; the first run's listings stay
    more = [("Casa Mar", "70 €", "Cabaña", "/rooms/3", "2026-07-15", "2026-07-16", "Valencia", "P", "2026-07-02")]
    spark.createDataFrame(more, SCHEMA).write.json(os.path.join(tmpdir_path, "in2", "b0"))
    stream = spark.readStream.schema(SCHEMA).json(os.path.join(tmpdir_path, "in2", "*"))
    start_listing_upsert(stream, store, os.path.join(tmpdir_path, "ckpt2")).awaitTermination(120)
    got = {r.url: r.precio_noche for r in current_listings(spark, store, ["fecha_scraping"]).collect()}
    assert got == {"https://www.airbnb.es/rooms/1": 100, "https://www.airbnb.es/rooms/2": 90, "https://www.airbnb.es/rooms/3": 70}


def test_stream_merge(spark, tmpdir_path):
    """Two runs of a stream into the bucketed store, the second with a later
    price of a listing."""
    from stayspark.sources.market_store import ListingStore
    from stayspark.streaming.listings import start_listing_merge
    card = lambda n, price, day: (f"Casa {n}", f"{price} €", "Cabaña", f"/rooms/{n}", "2026-07-15", "2026-07-16", "Valencia", "P", day)
    store, src, ckpt = (os.path.join(tmpdir_path, x) for x in ("store", "in", "ckpt"))
    for b, rows in enumerate(([card(1, 90, "2026-07-01"), card(2, 80, "2026-07-01")], [card(1, 95, "2026-07-02")])):
        spark.createDataFrame(rows, SCHEMA).write.json(os.path.join(src, f"b{b}"))
        stream = spark.readStream.schema(SCHEMA).json(src + "/*")
        start_listing_merge(stream, store, ckpt, ["fecha_scraping"], buckets=4).awaitTermination(120)
    got = {r.url[-1]: r.precio_noche for r in ListingStore(spark, store, ["fecha_scraping"]).listings().collect()}
    assert got == {"1": 95, "2": 80}
