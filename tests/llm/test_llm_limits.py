"""Full surrogate spaces, and one reading task per archive."""

from lanewise.llm import surrogates, warc


def test_a_full_space_of_local_parts(spark):
    found = spark.createDataFrame([("email", f"{chr(97 + k)}@mail.com") for k in range(26)], "kind string, normal string")
    got = surrogates.assign(found, b"key").collect()
    assert len({g["surrogate"] for g in got}) == 26
    assert not {g["surrogate"] for g in got} & {g["normal"] for g in got}


def test_archives_are_read_by_as_many_tasks(spark):
    manifest = spark.createDataFrame([(f"/nowhere/{k}.warc.gz",) for k in range(12)], "path string")
    read = warc.read_archives(manifest, with_payload=False)
    assert read.rdd.getNumPartitions() == 12
