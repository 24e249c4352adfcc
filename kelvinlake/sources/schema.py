"""The document's Spark schema and, from the same table, how to read each field."""

from __future__ import annotations

UNCERTAINTY = (
    "array<struct<kind:string,assessment_number:int,evaluator:string,method:string,standard_value:string,"
    "expanded_value:string,positive_standard_value:string,negative_standard_value:string,positive_expanded_value:string,"
    "negative_expanded_value:string,coverage_factor:string,confidence_level:string>>"
)
REPEATABILITY = "array<struct<evaluator:string,method:string,standard_value:string>>"
DEVICE = "array<struct<evaluator:string,method:string,description:string,value:string,confidence_level:string>>"
_QUANTITY = (
    f"number:int,name:string,phase:string,component_id:int,solvent_component_ids:array<int>,"
    f"uncertainties:{UNCERTAINTY},repeatability:{REPEATABILITY},device_specifications:{DEVICE}"
)
_MEASURED = f"array<struct<number:int,value:string,value_double:double,significant_digits:int,uncertainties:{UNCERTAINTY},repeatability:{REPEATABILITY}>>"
_PURITY = (
    "array<struct<step:int,purification_methods:array<string>,analysis_methods:array<string>,mole_percent:string,mole_percent_digits:int,"
    "mass_percent:string,mass_percent_digits:int,volume_percent:string,volume_percent_digits:int,unspecified_percent:string>>"
)
COMPOUND = (
    "struct<local_id:int,common_names:array<string>,iupac_name:string,cas_name:string,formula:string,standard_inchi:string,"
    f"standard_inchi_key:string,cas_registry_number:string,samples:array<struct<number:int,source:string,status:string,purity:{_PURITY}>>>"
)
DATASET = (
    "struct<number:int,component_ids:array<int>,component_samples:array<struct<component_id:int,sample:int>>,purpose:string,compiler:string,"
    "contributor:string,date_added:string,phases:array<string>,"
    f"properties:array<struct<{_QUANTITY},group:string,method:string,presentation:string,reference_phase:string,standard_state:string>>,"
    f"variables:array<struct<{_QUANTITY}>>,constraints:array<struct<{_QUANTITY},value:string,significant_digits:int>>,"
    f"points:array<struct<index:int,variable_values:{_MEASURED},property_values:{_MEASURED}>>>"
)
CITATION = (
    "struct<authors:array<string>,title:string,publication_name:string,year:int,date:string,volume:string,pages:string,doi:string,url:string,"
    "document_type:string,source_type:string,document_origin:string,abstract:string,keywords:array<string>,language:string,trc_reference_id:string>"
)
RECOVERY = (
    "struct<strategy:string,failed_locator:string,failed_sha256:string,failed_media_type:string,failure_type:string,failure_message:string,"
    "lexical_numeric_text_preserved:boolean>"
)
DOCUMENT = (
    f"struct<version_major:int,version_minor:int,citation:{CITATION},compounds:array<{COMPOUND}>,datasets:array<{DATASET}>,"
    "related_xml_md5:string,warnings:array<string>,reaction_dataset_count:int>"
)
ERROR = "struct<kind:string,message:string>"
DECODED = f"ordinal long, member string, sha256 string, media_type string, recovery {RECOVERY}, document {DOCUMENT}, error {ERROR}"
