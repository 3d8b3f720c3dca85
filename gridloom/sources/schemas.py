"""Schemas of the stored relations and of the file data sets; nothing is inferred."""

BOX = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
JOB = (
    "id string, status string, stage string, rows bigint, cols bigint, name string, crop_box " + BOX + ", valid_codes array<string>, input_image_path string, color_library_version string, "
    "model_snapshot string, attempt int, retry_count int, max_retries int, processed_cells bigint, total_cells bigint, heartbeat_at timestamp, error_code string, error_message string, blueprint_id string, created_at timestamp, updated_at timestamp"
)
JOB_CELL = "job_id string, row bigint, col bigint, code string, status string, color_code string, color_name string, color_hex string, confidence double, updated_at timestamp"
BLUEPRINT = "id string, job_id string, rows bigint, cols bigint, valid_codes array<string>, created_at timestamp"
BLUEPRINT_CELL = "blueprint_id string, row bigint, col bigint, code string, status string, color_code string, color_name string, color_hex string, confidence double, corrected_code string, corrected_at timestamp"
COLOR = "code string, name string, hex string, brand string, version string"
LIBRARY = "brand string, code string, color_name string, name string, color_hex string, hex string, sort_order int"
BOARD = "format_version int, board struct<brand:string,rows:int,cols:int,cell_size_px:int,blur_level:string>, cells array<struct<row:int,col:int,code:string,color_hex:string>>"
MODEL = "id string, name string, version string, input_name string, output_name string"
EVENT = "job bigint, attempt int, seq bigint, kind string, processed bigint, ts timestamp"
MANIFEST = "code string, file string, row int, col int, hue string, brightness int"
TRUTH = "rows int, cols int, image string, cells array<struct<row:int,col:int,code:string,confidence:double,source:string>>"
