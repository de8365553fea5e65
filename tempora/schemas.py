"""Spark schemas of the datasets, in DDL."""

FLAG = "struct<code:string,message:string>"
FLAGS = f"array<{FLAG}>"
RELATION = "struct<source:string,target:string,type:string,evidence:string>"
PARTICIPANT = "struct<name:string,type:string,role:string>"
COORDINATES = "latitude:double,longitude:double,current_latitude:double,current_longitude:double,suggested_latitude:double,suggested_longitude:double,geocode_source:string,geocode_display_name:string"
GEOCODE = f"struct<{COORDINATES}>"
ENTITY = f"struct<name:string,type:string,aliases:array<string>,review_flags:{FLAGS},{COORDINATES}>"
EVENT = (
    f"struct<event_id:string,event_type:string,event_date:string,date_precision:string,location:string,participants:array<{PARTICIPANT}>,"
    f"relations:array<{RELATION}>,summary:string,evidence:string,confidence:double,review_status:string,review_flags:{FLAGS},location_geocode:{GEOCODE}>"
)
ARTICLE_COLUMNS = "article_id string, title string, source string, published_at string, url string, source_url string, model string, prompt_version string, extracted_at string"
EXTRACTION = (
    f"{ARTICLE_COLUMNS}, entities array<{ENTITY}>, relations array<{RELATION}>, events array<{EVENT}>, validation_status string, validation_warnings array<string>, "
    f"candidate_model string, candidate_prompt_version string, extraction_method string, stages array<string>, postprocess_review_flags {FLAGS}"
)
ARTICLE = (
    "article_id string, source string, source_type string, title string, published_at string, updated_at string, url string, description string, authors array<string>, "
    "section string, language string, filename string, text string, paragraphs array<string>, word_count int"
)
PROMO = "headline string, url string, type string, published_at string, page_number int, article_id string, filename string, status string"
FAILURE = "article_id string, title string, error string"
GEOCODE_RECORD = "query string, latitude double, longitude double, display_name string, source string, osm_type string, osm_category string, osm_addresstype string, raw_importance double, notes string"
GOLD = (
    f"article_id string, title string, source string, source_url string, published_at string, annotation_status string, annotation_notes array<string>, "
    f"entities array<{ENTITY}>, relations array<{RELATION}>, events array<{EVENT}>"
)
REVIEW = (
    "article_id string, title string, status string, gold_index int, hybrid_index int, match_similarity double, field_mismatches string, gold_event_type string, hybrid_event_type string, "
    "gold_event_date string, hybrid_event_date string, gold_location string, hybrid_location string, gold_summary string, hybrid_summary string, gold_evidence string, hybrid_evidence string, "
    "review_decision string, review_notes string"
)
REVIEW_COLUMNS = [c.split()[0] for c in REVIEW.split(", ")]
GEOCODE_REVIEW_COLUMNS = ["location_name", "article_id", "event_summary", "source_url", "current_latitude", "current_longitude", "suggested_latitude", "suggested_longitude"]
LOCATION_REVIEW_COLUMNS = ["name", "latitude", "longitude", "display_name", "geocode_source", "review_code", "review_message"]
