"""Row types of the nested records (DDL strings usable with ``from_json`` and readers)."""

HEADER = ("struct<name:string,title:string,email:string,phone:string,location:string,"
          "postal_code:string,github:string,linkedin:string>")
EXPERIENCE = ("array<struct<title:string,company:string,period:string,date_start:string,date_end:string,"
              "duration_months:int,is_current:boolean,years:double,bullets:array<string>>>")
EDUCATION = ("array<struct<degree:string,school:string,year:string,date_start:string,date_end:string,"
             "duration_months:int,is_current:boolean,skills:array<string>>>")
PROJECTS = ("array<struct<name:string,description:string,stack:array<string>,url:string,"
            "metrics:array<string>>>")
SKILLS = "map<string,array<string>>"

CV = (f"doc_id bigint, header {HEADER}, summary string, skills {SKILLS}, experience {EXPERIENCE}, "
      f"education {EDUCATION}, projects {PROJECTS}, languages array<string>, raw_text string, "
      "layout_detected string, word_count int, extraction_method string, extraction_confidence double, "
      "sections map<string,string>, skills_flat array<string>, experience_years double, "
      "job_title string, location string, postal_code string, sector string, keywords array<string>")

WORD = ("doc_id bigint, page int, text string, x0 double, x1 double, top double, bottom double, "
        "size double, fontname string")

LISTING = ("title string, company string, location string, description string, url string, "
           "salary_min double, salary_max double, contract_type string, source string, source_color string")
