"""The models that are known by name, as tables for ``configurations``, ``choose_models`` and verified fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Public model files, each pinned by its address, SHA-256 and size in bytes, with the parameters that its
# makers publish for it (threshold of the mask, of a box, growth of a box, most boxes) or the characters that it reads.
_HUB = "https://huggingface.co/PaddlePaddle"
_SCOPE = "https://www.modelscope.cn/models/RapidAI/RapidOCR/resolve/v3.9.2/onnx"
DETECTORS = [
    ("v4", f"{_SCOPE}/PP-OCRv4/det/ch_PP-OCRv4_det_mobile.onnx", "d2a7720d45a54257208b1e13e36a8479894cb74155a5efe29462512d42f49da9", 4745517, 0.3, 0.6, 1.5, 1000),
    ("v5", f"{_SCOPE}/PP-OCRv5/det/ch_PP-OCRv5_det_mobile.onnx", "4d97c44a20d30a81aad087d6a396b08f786c4635742afc391f6621f5c6ae78ae", 4819576, 0.3, 0.6, 1.5, 1000),
    ("v6-tiny", f"{_HUB}/PP-OCRv6_tiny_det_onnx/resolve/2ba1506c0380b8f0b03dd142459aac66d4421f6c/inference.onnx", "193bab7a04fca699a6c82e6abb5b81bdb28177f0abd4062552b04908dafb19f8", 1780590, 0.2, 0.4, 1.4, 3000),
    ("v6-small", f"{_HUB}/PP-OCRv6_small_det_onnx/resolve/28fe5895c24fd108c19eb3e8479f4ab385fbfc62/inference.onnx", "d73e0058b7a8086bbd57f3d10b8bcd4ff95363f67e06e2762b5e814fe9c9410e", 9880512, 0.2, 0.45, 1.4, 3000),
]
_TINY, _SMALL = f"{_HUB}/PP-OCRv6_tiny_rec_onnx/resolve/2612ab37152ae0a677521bae4e1e3d4fb4cf7c30", f"{_HUB}/PP-OCRv6_small_rec_onnx/resolve/b8f84f0b80c529de40b4fbb3544b84fa7233a513"
RECOGNISERS = [
    ("v4", f"{_SCOPE}/PP-OCRv4/rec/ch_PP-OCRv4_rec_mobile.onnx", "48fc40f24f6d2a207a2b1091d3437eb3cc3eb6b676dc3ef9c37384005483683b", 10857958, "metadata", None, None, 6623),
    ("v5", f"{_SCOPE}/PP-OCRv5/rec/ch_PP-OCRv5_rec_mobile.onnx", "5825fc7ebf84ae7a412be049820b4d86d77620f204a041697b0494669b1742c5", 16631306, "metadata", None, None, 18383),
    ("v6-tiny", f"{_TINY}/inference.onnx", "9ef676d6ed3c88256a2d92c640c44f25b0c40947e111b14b8be8f594091563e6", 4462639, "yaml", f"{_TINY}/inference.yml", "66170210bad538e83fff3c4a3867e547d6bf20b50d64b20347c4b913f3034ea1", 6904),
    ("v6-small", f"{_SMALL}/inference.onnx", "5435fd747c9e0efe15a96d0b378d5bd157e9492ed8fd80edf08f30d02fa24634", 21159378, "yaml", f"{_SMALL}/inference.yml", "ab078671bb49f06228eadccd34f1bb501e157f7a047095ffb943ba81512c77d1", 18708),
]
#: What is used unless another is asked for, and what may be asked for.
DEFAULTS = {"det": "v6-tiny", "rec": "v6-tiny"}
LONG_SIDE = 960
SHIPPED = [("det", "v6-tiny"), ("det", "v6-small"), ("rec", "v6-tiny"), ("rec", "v6-small")]

_FILE = "id string, url string, sha256 string, size long"


def detectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DETECTORS, f"{_FILE}, thresh double, box_thresh double, unclip_ratio double, max_candidates int")


def recognisers(spark: SparkSession) -> DataFrame:
    """``charset_from`` tells where a model's characters are: in its own metadata, or in a YAML file of their own."""
    return spark.createDataFrame(RECOGNISERS, f"{_FILE}, charset_from string, charset_url string, charset_sha256 string, charset_count int")


def shipped(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHIPPED, "kind string, id string")
