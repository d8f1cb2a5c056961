"""Fixed values that results depend on."""

# Aspect-ratio tables, (ratio, height, width) in table order.
ASPECT_RATIO_1024 = [
    ("0.5625", 752, 1344),
    ("0.66", 896, 1344),
    ("0.75", 896, 1200),
    ("1.0", 1024, 1024),
    ("1.33", 1200, 896),
    ("1.5", 1344, 896),
    ("1.77", 1344, 752),
]

ASPECT_RATIO_512 = [
    ("0.25", 256, 1024),
    ("0.26", 256, 992),
    ("0.27", 256, 960),
    ("0.28", 256, 928),
    ("0.32", 288, 896),
    ("0.33", 288, 864),
    ("0.35", 288, 832),
    ("0.4", 320, 800),
    ("0.42", 320, 768),
    ("0.48", 352, 736),
    ("0.5", 352, 704),
    ("0.52", 352, 672),
    ("0.57", 384, 672),
    ("0.6", 384, 640),
    ("0.68", 416, 608),
    ("0.72", 416, 576),
    ("0.78", 448, 576),
    ("0.82", 448, 544),
    ("0.88", 480, 544),
    ("0.94", 480, 512),
    ("1.0", 512, 512),
    ("1.07", 512, 480),
    ("1.13", 544, 480),
    ("1.21", 544, 448),
    ("1.29", 576, 448),
    ("1.38", 576, 416),
    ("1.46", 608, 416),
    ("1.67", 640, 384),
    ("1.75", 672, 384),
    ("2.0", 704, 352),
    ("2.09", 736, 352),
    ("2.4", 768, 320),
    ("2.5", 800, 320),
    ("2.89", 832, 288),
    ("3.0", 864, 288),
    ("3.11", 896, 288),
    ("3.62", 928, 256),
    ("3.75", 960, 256),
    ("3.88", 992, 256),
    ("4.0", 1024, 256),
]

# The table that prompt flags are resolved against at inference.
ASPECT_RATIO_512_TEST = [
    ("0.25", 256, 1024),
    ("0.28", 256, 928),
    ("0.32", 288, 896),
    ("0.33", 288, 864),
    ("0.35", 288, 832),
    ("0.4", 320, 800),
    ("0.42", 320, 768),
    ("0.48", 352, 736),
    ("0.5", 352, 704),
    ("0.52", 352, 672),
    ("0.57", 384, 672),
    ("0.6", 384, 640),
    ("0.68", 416, 608),
    ("0.72", 416, 576),
    ("0.78", 448, 576),
    ("0.82", 448, 544),
    ("0.88", 480, 544),
    ("0.94", 480, 512),
    ("1.0", 512, 512),
    ("1.07", 512, 480),
    ("1.13", 544, 480),
    ("1.21", 544, 448),
    ("1.29", 576, 448),
    ("1.38", 576, 416),
    ("1.46", 608, 416),
    ("1.67", 640, 384),
    ("1.75", 672, 384),
    ("2.0", 704, 352),
    ("2.09", 736, 352),
    ("2.4", 768, 320),
    ("2.5", 800, 320),
    ("3.0", 864, 288),
    ("4.0", 1024, 256),
]

# The table that prompt flags are resolved against at inference.
ASPECT_RATIO_1024_TEST = [
    ("0.25", 512, 2048),
    ("0.28", 512, 1856),
    ("0.32", 576, 1792),
    ("0.33", 576, 1728),
    ("0.35", 576, 1664),
    ("0.4", 640, 1600),
    ("0.42", 640, 1536),
    ("0.48", 704, 1472),
    ("0.5", 704, 1408),
    ("0.52", 704, 1344),
    ("0.57", 768, 1344),
    ("0.6", 768, 1280),
    ("0.68", 832, 1216),
    ("0.72", 832, 1152),
    ("0.78", 896, 1152),
    ("0.82", 896, 1088),
    ("0.88", 960, 1088),
    ("0.94", 960, 1024),
    ("1.0", 1024, 1024),
    ("1.07", 1024, 960),
    ("1.13", 1088, 960),
    ("1.21", 1088, 896),
    ("1.29", 1152, 896),
    ("1.38", 1152, 832),
    ("1.46", 1216, 832),
    ("1.67", 1280, 768),
    ("1.75", 1344, 768),
    ("2.0", 1408, 704),
    ("2.09", 1472, 704),
    ("2.4", 1536, 640),
    ("2.5", 1600, 640),
    ("3.0", 1728, 576),
    ("4.0", 2048, 512),
]

# The template around the visible text of a sampled prompt.
TEXT_TEMPLATE_HEAD = "Generate the text '"
TEXT_TEMPLATE_TAIL = (
    "' centered on a pure white background. Use clean, sharp, highly legible "
    "typography with accurate letterforms, balanced spacing, crisp edges, strong contrast, and a minimal "
    "composition. Include no additional text, symbols, objects, decorations, borders, shadows, logos, "
    "or watermarks."
)

# Wording of prompts that carry visible text.
VISIBLE_ONE = "the visible word "
VISIBLE_MANY = "the visible words "
VISIBLE_LINK = ", with "
VISIBLE_END = " clearly rendered in the image."

# Sizes, limits and seeds.
SHARD_SIZE = 10_000
CLASS_COUNT = 1_000
SEED_CLASS_STRIDE = 1_000_003
SEED_EPOCH_STRIDE = 1_289_738_273
MAX_NAN_RUN = 20
BUCKET_CACHE_ITEM_BYTES = 1_100
BUCKET_CACHE_THRESHOLD_BYTES = 1 << 30
CONTRASTIVE_TEMPERATURE = 0.07
DESCRIPTOR_VERSION_FIELD = "wids_version"
DESCRIPTOR_VERSION = 1

# Members and fields a verified shard must have.
SHARD_EXTENSIONS = ["jpg", "json"]
SAMPLE_FIELDS = [
    "prompt",
    "original_caption",
    "texts",
    "annotations",
    "height",
    "width",
    "source_parquet",
    "source_row",
]
REQUIRED_COLUMNS = ["caption", "image", "annotations", "image_width", "image_height", "img_name"]
OPTIONAL_COLUMNS = ["wm_score"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]

# Patterns of prompts and file names.
VISIBLE_TEXT_PATTERN = r"(?is)Render\s+the\s+exact\s+visible\s+text\s+(.*?)\s+clearly\s+in\s+the\s+image"
SIZE_FLAG_VALUE = r"\s+(\d+:\d+)"
RECOVERY_NAME = r"^epoch_(\d+)_step_(\d+)_recovery(?:\.pth)?$"
