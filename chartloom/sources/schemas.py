"""Schemas of the records that documents turn into."""

RECORD = (
    "patient_name string, age string, gender string, date string, doctor_name string, hospital string, diagnosis array<string>, "
    "medicines array<struct<name:string,dosage:string,frequency:string>>, vitals struct<bp:string,temp:string,pulse:string>, instructions array<string>"
)
TRUTH = f"image_path string, type string, raw_text string, extracted_data struct<{RECORD.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>"
CANDIDATES = "array<array<struct<character:string,confidence:double>>>"
