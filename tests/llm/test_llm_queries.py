"""What the queries of this subpackage promise, on the smallest tables, where SQL can't say it."""

import pytest

pytest.importorskip("statloom.llm")
from statloom.llm import chunking, packing, queries, tokenizer  # noqa: E402


def test_links_name_what_exists_once(spark, small):
    found = [tuple(r) for r in queries.p2_found(spark, small).collect()]
    records = {r[0] for r in spark.read.parquet(f"{small}/key_stats.parquet").select("record_id").collect()}
    teams = {r[0] for r in spark.read.parquet(f"{small}/teams_cleaned.parquet").select("team_id").collect()}
    assert len(found) == len(set(found)) > 50 and all(a < b for _, a, b in found)
    assert all({a, b} <= (records if k == "player" else teams) for k, a, b in found if k != "club")
    assert all(len({a, b} & records) == len({a, b} & teams) == 1 for k, a, b in found if k == "club")
    persons = {r.record_id: r.person_id for r in queries.p2_persons(spark, small).collect()}
    assert set(persons) == records  # the pairs are those of one person
    assert {(a, b) for k, a, b in found if k == "player"} == {(a, b) for a in persons for b in persons if a < b and persons[a] is not None and persons[a] == persons[b]}


def test_a_listing_has_one_match(spark, small):
    links = queries.p4_links(spark, small).collect()
    listings = {r[0] for r in spark.read.parquet(f"{small}/fixture_listings.parquet").select("listing_id").collect()}
    matches = {r[0] for r in spark.read.parquet(f"{small}/matches_cleaned.parquet").select("match_id").collect()}
    assert len({r.listing_id for r in links}) == len(links) > 40
    assert all(r.listing_id in listings and r.match_id in matches and 0.7 <= r.confidence <= 1 for r in links)


def test_ids_of_all_documents(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {r.doc_id: r.ids for r in queries.p7_ids(spark, small).collect()}
    assert set(ids) == set(docs) and all((ids[k] == []) == (not t) for k, t in docs.items())


def test_documents_are_packed_whole(spark, small):
    sizes = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    packed = queries.p8_packed(spark, small).collect()
    taken: dict = {}
    for r in packed:
        taken.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.n_tokens))
    assert set(taken) == set(sizes)
    for k, parts in taken.items():
        assert sum(n for *_, n in parts) == sizes[k] and (len(parts) == 1 or sizes[k] > packing.CAPACITY)
    bins = queries.p8_containers(spark, small).collect()
    assert all(0 <= b.used <= packing.CAPACITY and b.used + b.unused == packing.CAPACITY for b in bins) and sum(b.used for b in bins) == sum(sizes.values())


def test_a_repeated_key_is_spread(spark):
    df = spark.createDataFrame([(None if i % 3 else 7, 100) for i in range(3000)], "doc_id long, n_tokens int").repartition(4)
    got = packing.pack(df, shards=8).collect()
    shards = {}
    for r in got:
        shards[r.container_id >> 40] = shards.get(r.container_id >> 40, 0) + 1
    assert len(got) == 3000 and len(shards) == 8 and max(shards.values()) < 600


def test_pieces_are_within_the_limit(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    parts: dict = {}
    for r in queries.p9_pieces(spark, small).collect():
        assert r.end_token - r.start_token <= chunking.LIMIT
        parts.setdefault(r.doc_id, []).append(r)
    assert set(parts) == set(docs)
    for k, own in parts.items():
        own.sort(key=lambda r: r.piece_no)
        text, at = "", 0
        for r in own:
            text += (r.text or "")[max(0, at - r.start_char) :]
            at = r.end_char
        assert text == (docs[k] or "") and all(r.overlap_tokens >= chunking.OVERLAP for r in own[1:])
