"""Named dataset builders and sample transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import ASPECT_RATIO_512, ASPECT_RATIO_1024
from ..operators.buckets import with_bucket, with_resize

Transform = Callable[[DataFrame], DataFrame]


class Registry:
    """Name to builder; a name is given once, an unknown one is an error."""

    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict[str, Callable] = {}

    def register(self, name: str | None = None):
        def add(item: Callable) -> Callable:
            key = name or item.__name__
            if key in self._items:
                raise KeyError(f"{key} is already registered in {self.kind}")
            self._items[key] = item
            return item

        return add

    def get(self, name: str) -> Callable:
        if name not in self._items:
            raise KeyError(f"{name} is not registered in {self.kind}")
        return self._items[name]

    def build(self, config: dict, defaults: dict | None = None):
        """Call the builder named by ``type`` with the defaults under the other settings."""
        if "type" not in config:
            raise KeyError("config needs a type")
        settings = {**(defaults or {}), **{k: v for k, v in config.items() if k != "type"}}
        return self.get(config["type"])(**settings)


DATASETS = Registry("datasets")
TRANSFORMS = Registry("transforms")
RATIO_TABLES = {"ASPECT_RATIO_512": ASPECT_RATIO_512, "ASPECT_RATIO_1024": ASPECT_RATIO_1024}


def apply_transforms(df: DataFrame, transforms: list[str | Transform]) -> DataFrame:
    """Transforms in order; a string is a registered shortcut."""
    for transform in transforms:
        df = df.transform(TRANSFORMS.get(transform)() if isinstance(transform, str) else transform)
    return df


@TRANSFORMS.register("default_train")
def default_train(height: str = "height", width: str = "width", ratio_table: str = "ASPECT_RATIO_512") -> Transform:
    """Bucket and resize geometry; decoding pixels is left to a function of the user."""

    def transform(df: DataFrame) -> DataFrame:
        return with_resize(with_bucket(df, height, width, RATIO_TABLES[ratio_table]), height, width)

    return transform


@TRANSFORMS.register("squeeze_text")
def squeeze_text(column: str = "text") -> Transform:
    from ..functions.text import squeeze

    return lambda df: df.withColumn(column, squeeze(F.col(column)))


@DATASETS.register("parquet_captions")
def parquet_captions(spark, path: str, key: str = "key", caption: str = "caption", min_chars: int = 0) -> DataFrame:
    """Captions of a parquet table as ``key, caption``."""
    df = spark.read.parquet(path).select(F.col(key).alias("key"), F.col(caption).alias("caption"))
    return df.where(F.length("caption") >= min_chars)


@DATASETS.register("tar_shards")
def tar_shards(spark, path: str, extensions: str | None = None) -> DataFrame:
    """Assembled samples of a folder of tar shards."""
    from ..sources.tar import assemble_samples, read_members

    return assemble_samples(read_members(spark, path, extensions))
