"""Schemas of the records that are read; fields that are not here are left out."""

GOLD = "struct<is_corrupted:boolean,from_summary_fixed:boolean,lies:array<string>,objects:array<string>,lie:string,subgroup:string>"
ANNOTATION = "struct<annotator:string,source_txt:string,n_claims:int,role:string>"
SIDECAR = (
    f"sample_id string, split string, caption string, text_block string, premise string, gold {GOLD}, visual_description string, "
    f"visual_claims array<string>, visual_annotation {ANNOTATION}, text_block_source string, figure_id string, figure_num string, "
    "page int, title string, arxiv_id string, pdf_id string, image_file string"
)
FIGURE = (
    "sample_id string, split string, label string, label_id int, gold_is_corrupted boolean, image_path string, sidecar_path string, caption string, "
    f"text_block string, visual_description string, visual_claims array<string>, visual_annotation {ANNOTATION}, premise string, gold {GOLD}"
)
HOLDOUT = FIGURE + ", source_sample_id string, domain string"
ANSWER = "struct<correct_things:array<string>,mistake_things:array<string>,critical_things:array<string>,verdict:string>"
LOG = f"record_key string, sample_id string, model string, target int, created_at_utc string, raw_output string, verdict string, parse_error string, parsed {ANSWER}, score double"
REASON = "index int, file string, local_pdf_path string, fixed array<struct<object:string,lie:string>>"
