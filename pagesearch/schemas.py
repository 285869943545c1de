"""Column names and types of the frames that operators exchange."""

from __future__ import annotations

ITEMS = "item_id bigint"
MEDIA = "item_id bigint, media_id bigint, position int, media_type string, source string, filename string, size bigint, data string"
IMAGES = "item_id bigint, image_index int, media_id bigint, width double, height double, source string"
QUERIES = "query_id bigint, item_id bigint, q string"
FILES = "item_id bigint, kind string, file_no int, media_id bigint, content binary"
MEDIA_VALUES = "item_id bigint, media_id bigint, position int, text string"

TEXTS = "text string"

#: Parsed pages and zones as files have them: sizes stay strings, since "" and "0" are told apart.
PARSED = (
    "item_id bigint, kind string, file_no int, page_in_file int, number string, page_width string, page_height string, "
    "zone_no int, text string, top string, left string, width string, height string"
)

#: Lookups of the JSON types: keys in order, with what each must hold.
ANNOTATION_KEYS = {"@context": "required", "@id": "required", "@type": "required", "motivation": "required", "resource": "required", "on": "required"}
HIT_KEYS = {"@type": "required", "annotations": "required", "match": "required", "before": "recommended", "after": "recommended"}
LIST_KEYS = {"@context": "required", "@id": "required", "@type": "required", "within": "optional", "startIndex": "optional", "resources": "required", "hits": "recommended"}

#: Fixed values of the search response format.
CONTEXT = "http://iiif.io/api/search/0/context.json"
CONTEXT_1 = "http://iiif.io/api/search/1/context.json"
PROFILE = "http://iiif.io/api/search/0/search"
PROFILE_1 = "http://iiif.io/api/search/1/search"
ANNOTATION_TYPE, MOTIVATION, BODY_TYPE = "oa:Annotation", "sc:painting", "cnt:ContextAstext"
HIT_TYPE, LIST_TYPE, LAYER_TYPE = "search:Hit", "sc:AnnotationList", "sc:Layer"

#: Media types whose text can be searched.
TSV, ALTO, PDF2XML = "text/tab-separated-values", "application/alto+xml", "application/vnd.pdf2xml+xml"
SEARCHABLE = (ALTO, PDF2XML, TSV)
GENERIC_XML = ("text/xml", "application/xml")
