"""Word lists of the text classifiers and the synonym groups of query expansion."""

from __future__ import annotations

# Results depend on these exact words.
INGEST_STOPS = """
the and for are but not you all can has was one our out this that with have from they been said each which their will
other about many then them these some would make like could into than its over such after also did any new most only
very when what how use used using does none just should
""".split()

CONTEXT_STOPS = """
the and for are but not you all can had her was one our out has his how its may new now old see way who did get got let
say she too use been call come each from have into just like long look make many more most much must name only over such
take than that them then this time very when will with about after also back been being both could does down even find
first give going here high just know last left life line little made make need never next once open part same should
show some still tell these thing think those through under used using want well were what where which while work would
year your true false none null undefined
""".split()

SESSION_STOPS = """
the a an is are was were be been being have has had do does did will would could should may might shall can to of in for
on with at by from as into through during before after above below between under again further then once here there
when where why how all each every both few more most other some such no not only same so than too very just don now also
but and or if this that these those it its they them their we our you your i me my he she his her what which who whom
let use make like get got one two new first well way about up out much right still thing need type messageid snapshot
issnaphotupdate parentuuid issidechain data tooltipuseid timestamp uuid usertype entrypoint cwd sessionid version
gitbranch entries fields true false null none
""".split()

FINGERPRINT_STOPS = """
the a an is are was were be been being have has had do does did will would could should may might can to of in for on
with at by from as into through during before after above below between then once here there when where why how all
each every both few more most other some such no not only same so than too very just now also but and or if this that
these those it its they them their we our you your me my he she his her what which who let use make like get got one two
new about up out much right still thing
""".split()

TECHNOLOGY = {
    "database": "postgresql postgres mysql sqlite mongodb redis dynamodb cassandra mariadb cockroachdb neo4j elasticsearch opensearch clickhouse timescaledb influxdb duckdb parquet supabase firestore",
    "caching": "memcached varnish cdn cloudflare",
    "container": "docker kubernetes k8s podman helm istio envoy",
    "cloud": "aws gcp azure lambda s3 ec2 fargate cloudrun vercel netlify heroku railway",
    "cicd": "github_actions jenkins circleci gitlab_ci argocd terraform pulumi ansible",
    "language": "rust python typescript javascript golang java swift kotlin ruby elixir haskell zig node deno bun",
    "framework": "react nextjs astro django flask fastapi express axum actix spring rails phoenix svelte vue angular tailwind htmx",
    "security": "oauth jwt tls ssl cors csrf xss sqli rbac iam vault keycloak argon2 bcrypt sha256 pqc kyber dilithium",
    "messaging": "kafka rabbitmq nats sqs pubsub zeromq",
    "monitoring": "prometheus grafana datadog splunk sentry opentelemetry jaeger loki",
    "search": "tantivy solr meilisearch typesense algolia",
    "ml": "pytorch tensorflow transformers llm gpt claude embeddings onnx huggingface",
    "protocol": "grpc graphql rest websocket mqtt http2 http3 quic",
    "infrastructure": "linux nginx caddy systemd wireguard",
    "testing": "pytest jest vitest playwright selenium cypress",
    "vcs": "git github gitlab bitbucket",
}

ACTIONS = """
decided,chose,selected,picked,agreed,fixed,resolved,patched,repaired,corrected,deployed,shipped,released,launched,published,
discovered,found,noticed,identified,detected,implemented,built,created,added,wrote,removed,deleted,dropped,deprecated,killed,
migrated,moved,transferred,ported,upgraded,configured,set up,initialized,provisioned,refactored,restructured,reorganized,
simplified,tested,verified,validated,benchmarked,profiled,reviewed,audited,inspected,analyzed,documented,noted,recorded,
logged,blocked,failed,broke,crashed,errored,reverted,rolled back,undid,restored,optimized,improved,accelerated,reduced,
integrated,connected,linked,wired,hooked,disabled,enabled,toggled,switched,investigated,debugged,traced,diagnosed,proposed,
suggested,recommended,planned,rejected,declined,vetoed,denied,approved,accepted,confirmed,signed off
""".replace("\n", "").split(",")

DOMAINS = {
    "backend": "api,endpoint,route,handler,middleware,server,microservice,service,rpc",
    "frontend": "component,page,layout,ui,ux,css,style,render,dom,responsive,animation",
    "infrastructure": "deploy,pipeline,container,cluster,load balancer,dns,cert,firewall,network,proxy,scaling,autoscale",
    "auth": "auth,login,signup,password,session,token,permission,role,access control,sso,mfa,2fa",
    "data": "schema,migration,query,index,table,column,row,record,etl,pipeline,warehouse,lakehouse",
    "devops": "ci,cd,build,release,rollback,canary,blue green,feature flag,monitoring,alerting,incident",
    "testing": "test,spec,coverage,assertion,mock,fixture,integration test,unit test,e2e,regression",
    "documentation": "readme,changelog,docs,docstring,tutorial,guide",
    "performance": "latency,throughput,benchmark,profiling,cache hit,bottleneck,memory leak,cpu",
}

#: Words with an apostrophe never equal a token and so never count.
NEGATIVE = """
not,didn't,rejected,against,failed,broken,broke,crash,crashed,error,bug,problem,issue,wrong,bad,worse,worst,blocked,stuck,
impossible,never,won't,can't,cannot,shouldn't,unable,deprecated,removed,killed,dropped,reverted,rollback,rolled back,downgrade,
regression,vulnerability,exploit,breach,leak,incident,outage,downtime,degraded,slow,timeout
""".replace("\n", "").split(",")

POSITIVE = """
fixed resolved shipped deployed launched improved optimized faster better solved completed done finished succeeded passed
approved accepted merged released stable secure validated verified confirmed green upgraded enhanced added new enabled
working ready clean refactored simplified
""".split()

NOT_ENTITIES = """
The This That These Those When Where What Which How Why For From With Into After Before About Also But And Not All Can Has
Was One Our Out Are Were Will Would Could Should May Might Just Like Only Very Most Some Many Each Every Any Few More Other
Such Than Then Now Here There If So Yet Still Even Well Too Much Back Over Down Off On Up No Yes Do Did Does Done Get Got Let
Make Say Said See Need Know Take Come Want Look Use Find Give Tell Work Call Try Ask Keep Put Run Move Live Next It We He She
Its His Her My They You I A An To In Of Is At By Be As Or TODO NOTE FIXME WARNING ERROR INFO DEBUG IMPORTANT CRITICAL MUST
SHALL SHOULD MAY TRUE FALSE NULL NONE OK HTTP HTTPS URL API CLI SQL CSS HTML JSON XML YAML TOML UTF ASCII EOF EOM
""".split()

TOPIC_TECHNOLOGY = """
rest graphql grpc http websocket mqtt amqp postgres mysql sqlite redis mongodb dynamodb cassandra docker kubernetes terraform
ansible nginx caddy react vue svelte angular nextjs astro remix python rust typescript golang java swift kotlin aws gcp azure
cloudflare vercel netlify jwt oauth saml oidc argon2 bcrypt parquet arrow json yaml toml protobuf avro tantivy elasticsearch
meilisearch typesense kafka rabbitmq nats pulsar s3 gcs blob
""".split()

TOPIC_DOMAINS = """
api protocol database storage cache queue messaging authentication authorization security encryption hashing deployment
infrastructure ci cd pipeline frontend backend fullstack server client framework library language runtime architecture design
pattern model schema testing monitoring logging observability config configuration settings environment migration upgrade
refactor rewrite memory search index ingest recall
""".split()

DECISION_MARKERS = """
decision,decided,choosing,chose,switch,switched,migrate,migrated,adopt,adopted,replace,replaced,moving to,moved to,use instead,
going with,picked,selected,selecting,prefer,preferred
""".replace("\n", "").split(",")

#: A term of several groups belongs to the last one.
SYNONYMS = """
database,db,rdbms,postgresql,postgres,mysql,sqlite,mongodb,datastore,sql
cache,caching,redis,memcached,varnish,cdn
queue,kafka,rabbitmq,nats,sqs,pubsub,message broker,messaging
decided,chose,selected,picked,agreed,went with,opted for
fixed,resolved,patched,repaired,corrected,solved,addressed
deployed,shipped,released,launched,published,pushed,went live
discovered,found,noticed,identified,detected,spotted,uncovered
created,built,implemented,added,wrote,developed,authored,introduced
removed,deleted,dropped,deprecated,killed,purged,eliminated
migrated,moved,transferred,ported,upgraded,transitioned
refactored,restructured,reorganized,simplified,cleaned up,reworked
tested,verified,validated,benchmarked,profiled,checked,confirmed
reviewed,audited,inspected,analyzed,examined,evaluated,assessed
broke,broken,crashed,failed,errored,degraded
reverted,rolled back,undid,restored,reset
optimized,improved,accelerated,reduced,sped up,tuned,enhanced
integrated,connected,linked,wired,hooked,coupled
debugged,investigated,traced,diagnosed,troubleshot
rejected,declined,vetoed,denied,refused,turned down
approved,accepted,confirmed,signed off,green-lit,okayed
container,docker,kubernetes,k8s,podman,containerized
cloud,aws,gcp,azure,cloud provider,iaas,paas,saas
backend,server,api,endpoint,service,microservice,serverside
frontend,ui,ux,client,browser,clientside,web app
infrastructure,infra,devops,platform,ops,sre
auth,authentication,authorization,login,sso,oauth,identity
security,sec,appsec,infosec,cybersecurity,vulnerability,threat
test,testing,spec,unit test,integration test,e2e,qa,quality
monitoring,observability,logging,alerting,tracing,metrics,apm
performance,perf,latency,throughput,benchmark,speed,optimization
data,schema,migration,etl,pipeline,warehouse,lakehouse,dataset
documentation,docs,readme,changelog,wiki,guide,tutorial
rust,cargo,crate,rustc,clippy
python,pip,pytest,pypi,virtualenv,conda
javascript,typescript,js,ts,node,npm,yarn,pnpm,deno,bun
swift,swiftui,uikit,xcode,cocoapods,spm
react,nextjs,jsx,tsx,hooks,react native
config,configuration,settings,env,environment,dotenv,toml,yaml
error,exception,panic,crash,fault,failure,bug,defect,issue
ci,cd,cicd,pipeline,workflow,github actions,jenkins,build
api,rest,graphql,grpc,endpoint,route,rpc,openapi,swagger
git,commit,branch,merge,rebase,pull request,pr,diff
search,query,index,tantivy,elasticsearch,full text,fts
ml,ai,machine learning,deep learning,model,inference,training,llm
encryption,encrypt,decrypt,cipher,aes,rsa,pqc,kyber,tls,ssl
file,directory,folder,path,filesystem,fs
network,dns,http,https,tcp,udp,websocket,socket,proxy
""".strip()

PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "us_phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
CREDENTIALS = {
    "openai_key": r"sk-[a-zA-Z0-9]{20,}",
    "aws_key": r"AKIA[A-Z0-9]{16}",
    "bearer_token": r"Bearer\s+[a-zA-Z0-9._~+/=-]{20,}",
    "github_pat": r"ghp_[a-zA-Z0-9]{36}",
    "private_key": r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
    "anthropic_key": r"sk-ant-[a-zA-Z0-9-]{20,}",
}
AUDIT_SECRETS = [
    r"-----BEGIN .* KEY-----",
    r"ssh-(rsa|ed25519|ecdsa)\s+\S{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)(aws_secret|secret_access)\S*\s*[=:]\s*\S{20,}",
    r"[0-9a-zA-Z+/]{86}==",
    r"(?i)DefaultEndpointsProtocol=",
    r'"private_key_id"\s*:\s*"',
    r'"private_key"\s*:\s*"-----BEGIN',
    r"sk-[a-zA-Z0-9]{20,}",
    r"sk-ant-[a-zA-Z0-9]{20,}",
    r"ghp_[a-zA-Z0-9]{36,}",
    r"github_pat_[a-zA-Z0-9]{22,}",
    r"xox[bpsar]-[0-9a-zA-Z-]{10,}",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"/Users/[a-zA-Z0-9._-]+/",
    r"/home/[a-zA-Z0-9._-]+/",
    r"C:\\Users\\[a-zA-Z0-9._-]+\\",
    r"(?i)\b(password|passwd|secret|token|credential)\b",
    r"[0-9a-f]{64,}",
]
INJECTIONS = ["system:", "assistant:", "ignore previous", "you are now", "disregard", "forget your"]
BOILERPLATE = ["<system-reminder>", "system-reminder", "You are Claude", "You are an interactive agent", "IMPORTANT: Assist with authorized", "# System\n", "# Environment\n", "<available-deferred-tools>"]
# Folders below the home folder that are never scanned, and those whose files are never changed.
SENSITIVE_FOLDERS = [".ssh", ".gnupg", ".gpg", ".aws", ".azure", ".config/gcloud", ".docker", ".kube", ".vault-token", ".terraform"]
PROTECTED_FOLDERS = [".claude", ".cursor", ".config/github-copilot"]
BLOCKED_KEYS = ["safety.", "security.", "tool_policy."]
# End of the fixed values.


def pairs(table: dict[str, str], sep: str | None) -> list[tuple[str, str]]:
    """(word, class) for every word of ``table``."""
    return [(w, c) for c, words in table.items() for w in words.split(sep)]


def synonyms() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in SYNONYMS.splitlines():
        group = line.split(",")
        out |= dict.fromkeys(group, group)
    return out
