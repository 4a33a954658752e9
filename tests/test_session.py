"""Session sizing and the checkpoint folder rule."""
from mercato.session import checkpoint_dir, sized_conf


def test_sized_conf_scales_with_input():
    small = sized_conf(10 << 20, 8)
    big = sized_conf(100 * (1 << 40), 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16          # two waves on 8 cores
    n = int(big["spark.sql.shuffle.partitions"])
    assert n % 8000 == 0 and 100 * (1 << 40) / n <= 256 << 20        # partitions of <= 256 MB
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 256 << 20


def test_checkpoint_dir_local_fallback(spark):
    assert checkpoint_dir(spark)


def test_threads_wait_for_the_package(monkeypatch):
    """It is added once, and no thread goes on before it is there."""
    import time
    from concurrent.futures import ThreadPoolExecutor
    from types import SimpleNamespace

    from mercato import session
    monkeypatch.setattr(session, "_SHIPPED", set())
    added = []

    def add(path):
        time.sleep(0.2)
        added.append(path)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app", addPyFile=add))

    def start(_):
        session.ship(spark)
        return len(added)
    with ThreadPoolExecutor(8) as ex:
        assert list(ex.map(start, range(8))) == [1] * 8
