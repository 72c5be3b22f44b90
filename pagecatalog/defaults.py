"""Fixed values. Selector lists, delays and limits that results depend on."""

# Selectors in priority order, the first that matches wins.
GROUP_SELECTORS = (
    ".drug-group a",
    ".card a",
    ".panel a",
    'a[href*="/drugs/groups/"]',
    'a[href*="/DrugGroups/"]',
)
RECORD_SELECTORS = (".col-md-6 .ahref_Generic",)
MANUFACTURER_SELECTORS = (
    ".drug-company",
    ".medicine-company",
    ".manufacturer",
    ".company",
    ".producer",
)
IMAGE_SELECTORS = (
    ".drug-image img",
    ".medicine-image img",
    ".product-image img",
    ".image img",
    "img.product",
    "img.drug",
    ".gallery img",
)
INGREDIENTS_SELECTORS = (
    ".drug-ingredients",
    ".medicine-ingredients",
    ".ingredients",
    ".composition",
    ".formula",
    ".active-ingredients",
)
TITLE_SELECTORS = ("h1",)
ENGLISH_TITLE_SELECTORS = (".EnglishTopLabel",)
CHILD_LINK_SELECTORS = (".text-xs-center .ahref_Generic",)
CHILD_PERSIAN_SELECTORS = ("#h1PersianName",)
CHILD_ENGLISH_SELECTORS = ("#h2EnglishName",)
CHILD_MANUFACTURER_SELECTORS = (".ahref_GenericWhiteColor",)

# The second source's selectors.
LETTER_SELECTORS = ("ul.az-list a",)
ITEM_SELECTORS = ("ul.ddc-list-column-2 li a",)
LABEL_SELECTOR = "div.ddc-media-body dt"
LABEL_WORD = "Manufacturer"
SOURCE_IMAGE_SELECTOR = "div.ddc-media img"
DESCRIPTION_SELECTOR = "div.ddc-media-body"
HIT_SELECTOR = "div.product-item"
HIT_LINK_SELECTOR = "h2 a"
PRODUCT_MANUFACTURER_SELECTOR = "span.manufacturer"
PRODUCT_IMAGE_SELECTOR = "div.product-image img"

# Seconds.
REQUEST_DELAY = 0.5
PAGE_DELAY = 0.3
BATCH_DELAY = 1.0

# Counts.
MAX_ATTEMPTS = 3
MAX_PAGES = 5
BATCH_SIZE = 50
SNAPSHOT_EVERY = 4
IMAGES_PER_CHILD = 5
REQUESTS_PER_SECOND = 10
CAPTURE_HOURS = 24

# Texts that records and files hold.
NO_RECORD_ERROR = "Extraction returned None"
ARRAY_SEPARATOR = "; "
UNKNOWN = "Unknown"
